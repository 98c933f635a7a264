"""Markup residue in text documents: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

The content region is the maximum-scoring contiguous run of tokens: words score positive, tags by weights that are
log odds counted on labelled pages (fit_weights; labelled_pages takes them from a table), found in one linear scan. The
elements in which it begins and ends stay whole; all that lies outside is dropped: scripts, styles, preambles, bars of links,
menus, footers, infoboxes, categories. The region is cut into blocks at blank lines, with code, formulas and scripts
protected. The marks in a block tell its kind; a block whose signs could belong to several kinds takes that of its
surroundings. Headings, list items, code blocks and formulas are kept, everything else becomes plain text. The kinds
of marks are those of the whole document.

Defined results
* Null, empty and blank texts give empty clean text, no kinds and no elements.
* Signs that merely occur in plain text (5 * 3, a < b, C#, snake_case, $ 3) are no marks.
* Elements: text without marks, entities and escapes resolved, white space collapsed; code and formulas stand as
  between their delimiters, with white space collapsed (in HTML, where code is escaped, entities resolved).
* Dollar formulas belong to Markdown in Markdown surroundings, else to LaTeX. ref, math, syntaxhighlight and nowiki
  tags belong to wiki writing.
* Unclosed code and tags reach to the end of the text or of their block. Nothing is cut short: texts are whole.
* Markdown code that is only indented by four blanks is not recognised: it is read as other Markdown text.
* Rows repeated under one id give the same rows once in p3_found. Null ids are left out. Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
_P = "\x01(\\d+)\x02"  # a protected piece

_PROTECTED = re.compile(
    r"(?ims)^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*(?:\n(?P<fenced>.*?))??(?:\n[ ]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)"
    r"|<(?P<tag>pre|syntaxhighlight|source(?![^>]*\bsrc(?:set)?\s*=)|script|style|math)\b[^>]*>(?P<tagged>.*?)(?:</(?P=tag)\s*>|\Z)"
    r"|\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?P<code>.*?)(?:\\end\{(?P=env)\}|\Z)"
    r"|\\begin\{(?P<menv>equation\*?|align\*?|gather\*?|multline\*?|displaymath|eqnarray\*?)\}(?P<formula>.*?)(?:\\end\{(?P=menv)\}|\Z)"
    r"|(?<!\$)\$\$(?P<display>[^$]+?)\$\$(?!\$)"
)
_HTML_TAG = r"(?:a|abbr|article|aside|b|big|blockquote|body|br|button|center|cite|code|dd|del|div|dl|dt|em|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|ol|p|q|s|section|small|span|strike|strong|sub|sup|table|tbody|td|tfoot|th|thead|title|tr|tt|u|ul)"
#: The other elements, of graphics too. Names like these also stand in angle brackets in plain text: alone they prove nothing.
_RARE_TAG = r"(?:acronym|address|altglyph|animate|animatemotion|animatetransform|applet|area|audio|base|basefont|bdi|bdo|canvas|caption|circle|clippath|col|colgroup|data|datalist|defs|desc|details|dfn|dialog|dir|ellipse|embed|fieldset|figcaption|filter|foreignobject|frame|frameset|g|hgroup|image|keygen|legend|line|lineargradient|map|marker|marquee|mask|menu|menuitem|meta|meter|nobr|noframes|noscript|object|optgroup|option|output|param|path|pattern|picture|polygon|polyline|progress|radialgradient|rect|rp|rt|ruby|samp|search|select|slot|source|stop|summary|svg|symbol|template|text|textarea|textpath|time|track|tspan|use|var|video|wbr)"
_EVIDENCE = {
    "latex": re.compile(r"\\(?:documentclass|begin|end|usepackage|title|author|(?:sub){0,2}section|(?:sub)?paragraph|chapter|part|textbf|textit|texttt|textsc|emph|underline|cite[pt]?|ref|eqref|label|href|footnote|url|caption)\*?\s*[\[{]|^\s*\\item\b|\\\((?:(?!\\\().)+?\\\)|\\\[(?:(?!\\\[).)+?\\\]", re.M | re.S),
    "html": re.compile(rf"</?{_HTML_TAG}(?:\s[^<>]*)?/?>|</{_RARE_TAG}\s*>|<{_RARE_TAG}\s+[\w:-]+\s*=[^<>]*>|<!--|<!doctype\b", re.I),
    "wiki": re.compile(r"^(={1,6})[ \t]*[^=\s](?:[^\n]*?[^=\s])?[ \t]*\1[ \t]*$|''[^'\n]+''|\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|\[https?://[^\s\[\]]+ [^\[\]\n]+\]|__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__|</?(?:ref|nowiki|gallery|references)\b[^>]*>|^\{\|", re.M),
    "markdown": re.compile(r"^[ ]{0,3}#{1,6}[ \t]+\S|^[^\s\n][^\n]*\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*$|(?<![\w*\\])(\*{1,3})(?=[^\s*])[^*\n]+?(?<=[^\s*])\1(?![\w*])|(?<![\w\\])(_{1,3})(?=[^\s_])(?!_{0,2}(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)_)[^\n]+?(?<=[^\s_])\2(?!\w)|(?<!~)~~(?=[^\s~])[^~\n]*~~|(?<![`\\])`(?=[^`\s])[^`\n]+`(?!`)|!?\[[^\[\]\n]+\]\([^)\s]+\)|\[\^[\w-]+\]|^[ ]{0,3}>[ \t]", re.M),
}
_WEAK_LIST = re.compile(r"^[ \t]*(?:[*+-]|\d{1,9}[.)])[ \t]+\S", re.M)
_DOLLAR = re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]+?)(?<=[^\s$\\])\$(?![\w$])")


class _Piece:
    """A protected piece: what it is, the kind it proves (None: its surroundings'), what it holds."""

    __slots__ = ("body", "kind", "what")

    def __init__(self, what: str, kind: str | None, body: str):
        self.what, self.kind, self.body = what, kind, body


#: Characters that stand for pieces taken out are none of a text's own.
_BLANKED = {c: " " for c in range(1, 7)}


def _protect(text: str) -> tuple[str, list[_Piece]]:
    pieces: list[_Piece] = []

    def take(m: re.Match) -> str:
        if m["fence"]:
            p = _Piece("code", "markdown", m["fenced"] or "")
        elif m["tag"]:
            tag = m["tag"].lower()
            what, kind = {"pre": ("code", None), "math": ("formula", "wiki"), "script": ("drop", "html"), "style": ("drop", "html")}.get(tag, ("code", "wiki"))
            p = _Piece(what, kind, m["tagged"])
        elif m["env"]:
            p = _Piece("code", "latex", m["code"])
        elif m["menv"]:
            p = _Piece("formula", "latex", m["formula"])
        else:
            p = _Piece("dollar", None, m["display"])
        pieces.append(p)
        return f"\x01{len(pieces) - 1}\x02"

    return _PROTECTED.sub(take, text.translate(_BLANKED)), pieces


def _proof(block: str, pieces: list[_Piece]) -> tuple[set[str], set[str]]:
    """Kinds that the block proves, and kinds that its signs allow."""
    sure = {k for k, p in _EVIDENCE.items() if p.search(block)}
    may: set[str] = set()
    lines = [x for x in block.split("\n") if x.strip()]
    if len(lines) > 1 and (all(re.match(r"#+[ \t]*\S", x) for x in lines) or all(re.match(r"[*#]+[^\s*]", x) for x in lines)):
        sure = {"wiki"}  # numbered or close-set lists; a heading per line is no Markdown
    for n in re.findall(_P, block):
        p = pieces[int(n)]
        if p.kind:
            sure.add(p.kind)
        else:
            may |= {"html", "wiki"} if p.what == "code" else {"markdown", "latex"}
    if _WEAK_LIST.search(block):
        may |= {"markdown", "wiki"}
    if _DOLLAR.search(block):
        may |= {"markdown", "latex"}
    return sure, may


def _kinds(blocks: list[str], pieces: list[_Piece]) -> list[str | None]:
    """The kind of each block: its own proof, else what its signs allow of the kinds around it."""
    proofs = [_proof(b, pieces) for b in blocks]
    after: list[str | None] = [None] * len(blocks)
    nxt = None
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = nxt
        sure = proofs[i][0]
        if sure:
            nxt = next(k for k in ("latex", "wiki", "html", "markdown") if k in sure)
    out: list[str | None] = []
    cur = None
    for i, (sure, may) in enumerate(proofs):
        if sure:
            if cur not in sure:
                cur = after[i] if after[i] in sure else next(k for k in ("latex", "wiki", "html", "markdown") if k in sure)
            out.append(cur)
        elif may:
            if cur in may:
                out.append(cur)
            elif after[i] in may:
                out.append(after[i])
            else:
                out.append("latex" if "latex" in may and "html" not in may else "html" if "html" in may else "markdown" if len(blocks[i].split("\n")) > 1 else cur)
        else:
            out.append(cur or after[i])
    return out


# ---- the content region -------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"^[ ]{0,3}(?P<head>#{1,6}[ \t]|={1,6})|^[ \t]*(?P<item>[*+-][ \t]|\d{1,9}[.)][ \t]|[*#]+)|\x01(?P<piece>\d+)\x02|</?(?P<tag>[A-Za-z][A-Za-z0-9]*)\b[^<>]*>|(?P<comment><!--.*?(?:-->|\Z))|\\(?P<command>(?:begin|end)\s*\{[\w*]+\}|[a-zA-Z]+)|(?P<wiki>\{\{|\}\}|\[\[|\]\]|__[A-Z]+__)|(?P<word>\w+)", re.S | re.M)
_TEX_HEADING = re.compile(r"chapter|part|(?:sub){0,2}section|(?:sub)?paragraph")
#: Pages with their content marked, for the weights: (is content, text).
LABELLED: tuple[tuple[tuple[bool, str], ...], ...] = (
    ((False, "<html><head><meta charset=utf8><link href=x><title>Pumps</title><style>p{color:red}</style><script>var a=1;track(a)</script></head><body><nav><a href=1>Home</a> <a href=2>Shop</a> <a href=3>Login</a></nav>"), (True, "<h1>Pump room</h1><p>The pump was checked in May and ran <b>well</b> for ten days.</p><ul><li>Open the valve</li><li>Note the time</li></ul><pre>start --now</pre><p>Nobody saw a leak, so the log was closed.</p>"), (False, "<footer><a href=4>Imprint</a> <a href=5>Privacy</a><script>load()</script></footer></body></html>")),
    ((False, "<div><a href=a>One</a><a href=b>Two</a><a href=c>Three</a></div><form><input name=q><button>Go</button></form>"), (True, "<h2>How to read a meter</h2><div><p>Stand in front of the meter and <em>wait</em> until the hand rests.</p><ol><li>Write the number down</li></ol><p>Send it to the office by the end of the week.</p></div>"), (False, "<div><img src=x><iframe src=y></iframe><script>ad()</script></div>")),
    ((False, "{{Infobox | name = pump | size = 3 }}"), (True, "== Use ==\nThe '''pump''' moves [[water|cold water]] into the tank. It was built in March.\n* first step\n* second step\n<syntaxhighlight>run()</syntaxhighlight> and <math>a+b</math> hold."), (False, "[[Category:Pumps]] [[Category:Tanks]] __NOTOC__ {{stub}}")),
    ((False, "\\documentclass{article} \\usepackage{graphicx} \\begin{document}"), (True, "\\section{Use} The pump was \\emph{checked} twice \\cite{a} and the tank was full. \\begin{itemize} \\item open it \\item close it \\end{itemize} The log says otherwise."), (False, "\\bibliographystyle{plain} \\bibliography{refs} \\end{document}")),
    ((True, "<h3><a href=1>Pump</a> notes</h3><p>See the <a href=2>log</a> of May<br/>and the <code>run</code> of <span>June</span>.<img src=a> It was <i>short</i>, as the <a href=3>list</a> says.</p><ul><li><a href=4>Valve</a> of the tank</li><li>Hose <sup>1</sup></li></ul>"), (False, "<div><a href=5>Up</a> <a href=6>Down</a><script>x()</script></div>")),
    ((False, "<style>b{}</style><script>a()</script>"), (True, "<h4>Reading <a href=1>room</a></h4>\n<div><p>Every <span>room</span> has a meter.<!-- n --> Ask the <a href=2>desk</a> for a key.<br></p></div><h2><a href=3>Keys</a></h2><ol><li>One <em>key</em></li><li>Two <code>keys</code></li></ol><p>Bring them <strong>back</strong> by noon.</p>"), (False, "<nav><a href=4>Next</a></nav>")),
    ((False, "__NOTOC__\n"), (True, "=== Keys ===\nAsk the [[desk]] for [[key (tool)|a key]] of the ''room''.{{source|a}}\n# [[open]] it\n# close [http://x the door]\n== Rooms ==\nEvery [[room]] has {{two}} meters.<ref>n</ref> They are read in May."), (False, "{{navigation | a = 1 | b = 2}} [[Category:Keys]]")),
    ((True, "\\subsection{\\texttt{Keys} and rooms} Ask the \\href{http://x}{desk} for \\textbf{a key}. \\paragraph{Rooms} They are \\underline{open} \\textit{today} \\footnote{See b.} \\label{r}."), (False, "\\bibliography{refs} \\end{document}")),
    ((True, "<details><summary>How to oil it</summary><p>Lift the <var>lid</var> and wait for the <samp>ready</samp> sign.</p></details><figure><figcaption>The lid from above</figcaption></figure><table><caption>Oils by season</caption><thead><tr><th>season</th><th>oil</th></tr></thead><tbody><tr><td>winter</td><td>thin oil</td></tr></tbody></table><video><source src=a>A film of the pump</video><blockquote>It runs for years.</blockquote><dl><dt>lid</dt><dd>the upper part</dd></dl><svg><path d=M0></path><text>scale</text></svg><label>Size <select><option>small</option></select></label><noscript>A list of sizes</noscript>"), (False, "<form><input name=a><button>Send</button></form>")),
    ((True, "# Use\n\nThe pump was **checked** and the [log](x) was closed by the team in the evening.\n\n- open\n- close\n\n```\nrun\n```\n"), (False, "[![badge](a)](b) <img src=c> <br> <sub></sub>")),
)


def _classes(text: str, pieces: list[_Piece]) -> list[tuple[int, int, str]]:
    out = []
    depth = 0  # of templates: a template is one, however many it holds
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "wiki" and m["wiki"] in ("{{", "}}"):
            opens = m["wiki"] == "{{"
            depth += opens
            if depth == 1:
                out.append((m.start(), m.end(), "wiki:template"))
            depth -= depth > 0 and not opens
            continue
        if kind == "piece":
            name = "kept" if pieces[int(m["piece"])].what != "drop" else "script"
        elif kind == "tag":
            tag = m["tag"].lower()
            name = "tag:h" if re.fullmatch("h[1-6]", tag) else f"tag:{tag}"  # headings of all levels share a weight
        elif kind == "command":
            name = "command:h" if _TEX_HEADING.fullmatch(m["command"]) else f"command:{m['command']}"
        elif kind == "wiki":
            name = "wiki:word" if m["wiki"][0] == "_" else "wiki:link"
        else:
            name = kind or "word"
        out.append((m.start(), m.end(), name))
    return out


def fit_weights(pages=LABELLED, smooth: float = 1.0) -> dict[str, float]:
    """Weight per token class: the log odds of being content, counted with add-`smooth` counts; words share one."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for content, text in page:
            body, pieces = _protect(text)
            (inside if content else outside).update(name for _, _, name in _classes(body, pieces))
    n, m = sum(inside.values()) + smooth, sum(outside.values()) + smooth
    names = set(inside) | set(outside)
    weights = {c: math.log((inside[c] + smooth) / n) - math.log((outside[c] + smooth) / m) for c in names}
    weights = {c: w if c in ("word", "kept", "head", "item", "tag:h", "command:h") else min(w, 0.0) for c, w in weights.items()}  # of tags only headings are content in themselves
    weights["word"] = max(weights.get("word", 1.0), 0.1)
    weights["kept"] = max(weights.get("kept", 1.0), weights["word"])
    weights["tag"] = min(-0.1, math.log(m / n))  # of a tag that no page shows
    weights["command"] = -0.1
    return weights


_WEIGHTS = fit_weights()


def labelled_pages(parts: DataFrame, most: int = 10_000) -> list[list[tuple[bool, str]]]:
    """Pages for fit_weights from a table parts(page, part, content, text): a page's parts in order, content true or false.

    A bounded sample: the `most` pages whose ids have the smallest hashes. Null texts and null marks are left out.
    """
    rows = parts.where(F.col("content").isNotNull() & F.col("text").isNotNull() & F.col("page").isNotNull())
    chosen = rows.select("page").distinct().orderBy(F.xxhash64("page"), "page").limit(most)
    one = F.sort_array(F.collect_list(F.struct("part", "content", "text"))).alias("parts")
    got = rows.join(chosen, "page").groupBy("page").agg(one).orderBy("page").collect()
    return [[(p["content"], p["text"]) for p in r["parts"]] for r in got]


def best_region(scores: list[float]) -> tuple[int, int]:
    """[lo, hi) of the contiguous run with the greatest sum, the longest of equals; (0, 0) if no sum is positive."""
    best, lo, hi = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and total > 0 and i + 1 - start > hi - lo):
            best, lo, hi = total, start, i + 1
    return lo, hi


def content_region(body: str, pieces: list[_Piece], weights: dict[str, float]) -> tuple[int, int]:
    """Offsets of the content region of a protected text; the whole text if it holds no token of worth."""
    tokens = _classes(body, pieces)
    weight = lambda c: weights.get(c, weights["tag"] if c.startswith("tag:") else weights["command"] if c.startswith("command:") else 0.0)
    lo, hi = best_region([weight(c) for _, _, c in tokens])
    return _whole_elements(body, tokens[lo][0], tokens[hi - 1][1]) if hi else (0, len(body))


#: Where an element of a page begins or ends: lines, HTML blocks, LaTeX sections, items and environments.
_EDGE = re.compile(r"(?P<after>\n|</(?:p|div|h[1-6]|li|[uo]l|table|tr|nav|footer|header|aside|form|section|article|main|blockquote|dl|head|body|html)\s*>|<(?:br|hr)\b[^<>]*>|\}\}(?!\}))|(?P<before><(?:p|div|h[1-6]|li|[uo]l|table|tr|nav|footer|header|aside|form|section|article|main|blockquote|dl|head|body)\b[^<>]*>|\{\{|\[\[(?:Category|File|Image):|\\(?:chapter|part|(?:sub){0,2}section|(?:sub)?paragraph|item|begin|end|bibliography\w*)\b)", re.I)


_ELEMENT = re.compile(r"<(h[1-6]|li|p)\b[^<>]*>(?:(?!<(?:h[1-6]|li|p|[uo]l|div)\b|\n[ \t]*\n).)*?</\1\s*>", re.I | re.S)


_TITLE = re.compile(r"<h([1-6])\b[^<>]*>(?:(?!<h[1-6]\b).)*?</h\1\s*>|^(={1,6})[^=\n][^\n]*\2[ \t]*$|^[ ]{0,3}#{1,6}[ \t][^\n]*$", re.I | re.S | re.M)


def _whole_elements(body: str, lo: int, hi: int) -> tuple[int, int]:
    """The region with the elements whole in which it begins and ends, and with the heading right before it; an underlined heading keeps its line."""
    start, stop = 0, len(body)
    for m in _EDGE.finditer(body):
        at = m.end() if m.lastgroup == "after" else m.start()
        if at <= lo:
            start = at
        elif at >= hi:
            stop = at
            break
    for m in _ELEMENT.finditer(body):  # a line may end within these
        if m.start() < start < m.end():
            start = m.start()
        if m.start() < stop < m.end():
            stop = m.end()
        if m.start() >= stop:
            break
    titles = [m.span() for m in _TITLE.finditer(body, 0, start)]
    if titles and not re.search(r"\w", _ANY_TAG.sub("", _without_templates(body[titles[-1][1] : start]))):
        start = titles[-1][0]  # the heading of what follows
    under = re.compile(r"\n?[ ]{0,3}(?:={2,}|-{2,})[ \t]*(?=\n|\Z)").match(body, stop)
    return start, under.end() if under else stop


# ---- inline marks -------------------------------------------------------------------------------------------------

_BLOCK_TAG = re.compile(r"</?(?:p|div|br|hr|table|tr|td|th|ul|ol|section|article|blockquote|body|html|head|header|footer|nav|dl|dt|dd|form|details|summary|figure|figcaption|caption|option|optgroup|fieldset|legend|address|dialog)\b[^<>]*>", re.I)
_ANY_TAG = re.compile(rf"</?(?:{_HTML_TAG}|{_RARE_TAG})(?:\s[^<>]*)?/?>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _inline_html(t: str) -> str:
    t = _COMMENT.sub("", t)
    t = _BLOCK_TAG.sub(lambda m: "\n" if m[0].lower().startswith(("<br", "<p", "</p", "<tr")) else " ", t)
    return html.unescape(_ANY_TAG.sub("", t))


def _without_templates(t: str) -> str:
    """The text without {{...}}, however deep they nest, in one scan; what holds a single brace is no template."""
    opened: list[list[int]] = []  # start and length of runs of braces that wait for their ends
    gone: list[tuple[int, int]] = []
    for m in re.finditer(r"\{+|\}+", t):
        at, left = m.start(), m.end() - m.start()
        if t[at] == "{":
            opened.append([at, left])
            if left == 1:
                opened.clear()
            continue
        while left > 1 and opened:
            run = opened[-1]
            run[1] -= 2
            at, left = at + 2, left - 2
            start = run[0] + run[1]
            while gone and gone[-1][0] >= start:
                gone.pop()
            gone.append((start, at))
            if run[1] == 1:
                opened.clear()
            elif not run[1]:
                opened.pop()
        if left:
            opened.clear()
    out, last = [], 0
    for start, end in gone:
        out.append(t[last:start])
        last = end
    return "".join([*out, t[last:]])


def _inline_wiki(t: str) -> str:
    t = _COMMENT.sub("", t)
    t = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?(?:</ref\s*>|\Z)", "", t, flags=re.S | re.I)
    t = _without_templates(t)
    t = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\[\]]+ ([^\[\]\n]+)\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\[\]]+\]", "", t)
    t = re.sub(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION)__", "", t)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"</?(?:nowiki|gallery|references|ref)\b[^>]*>", "", t, flags=re.I)
    return html.unescape(_ANY_TAG.sub("", _BLOCK_TAG.sub(" ", t)))


_MD_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def _inline_markdown(t: str) -> str:
    spans: list[str] = []

    def hold(s: str) -> str:
        spans.append(s)
        return f"\x03{len(spans) - 1}\x04"

    t = re.sub(r"(?<![`\\])(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: hold(m[2].strip()), t)
    t = _MD_ESCAPE.sub(lambda m: hold(m[1]), t)
    t = re.sub(r"\[\^[\w-]+\]:?", "", t)
    t = re.sub(r"!\[([^\[\]\n]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]+)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1", t)
    t = re.sub(r"<(https?://[^>\s]+)>", r"\1", t)
    t = re.sub(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*])\1(?![\w*])", r"\2", t)
    t = re.sub(r"(?<!\w)(_{1,3})(?=[^\s_])([^\n]+?)(?<=[^\s_])\1(?!\w)", r"\2", t)
    t = re.sub(r"(?<!~)~~(?=[^\s~])([^~\n]*)~~", r"\1", t)
    t = re.sub(r"\\(?=\s|$)", "", t)
    t = html.unescape(_ANY_TAG.sub("", _COMMENT.sub("", t)))
    return re.sub("\x03(\\d+)\x04", lambda m: spans[int(m[1])], t)


def _group(t: str, at: int, pair: str = "{}") -> int:
    """The end of the balanced group that opens at `at`, or the end of the text."""
    depth, i = 0, at
    while i < len(t):
        c = t[i]
        if c == "\\":
            i += 2
            continue
        if c == pair[0]:
            depth += 1
        elif c == pair[1]:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(t)


_TEX_COMMAND = re.compile(r"\\([a-zA-Z]+)\*?")
_TEX_DROP = {"cite", "citep", "citet", "ref", "eqref", "label", "footnote", "includegraphics", "documentclass", "usepackage", "begin", "end", "vspace", "hspace", "bibliography", "bibliographystyle", "pagestyle", "index"}
_TEX_SIGN = {"\\%": "%", "\\&": "&", "\\$": "$", "\\#": "#", "\\_": "_", "\\{": "{", "\\}": "}", "\\ ": " ", "\\,": " ", "\\\\": "\n", "\\-": ""}


def _inline_latex(t: str) -> str:
    t = re.sub(r"(?<!\\)%[^\n]*", "", t)
    out, i = [], 0
    while i < len(t):
        c = t[i]
        if c != "\\":
            if c == "~":
                out.append(" ")
            elif c not in "{}":
                out.append(c)
            i += 1
            continue
        sign = _TEX_SIGN.get(t[i : i + 2])
        if sign is not None:
            out.append(sign)
            i += 2
            continue
        m = _TEX_COMMAND.match(t, i)
        if not m:
            out.append(t[i : i + 1] if i + 1 >= len(t) or t[i + 1] in "()[]" else "")
            i += 1 if i + 1 >= len(t) else 2 if t[i + 1] in "()[]" else 1
            continue
        i = m.end()
        if m[1] in _TEX_DROP:
            while i < len(t) and t[i] in "[{":
                i = _group(t, i, "[]" if t[i] == "[" else "{}")
            continue
        if i < len(t) and t[i] == "[" and m[1] != "item":
            i = _group(t, i, "[]")
        if m[1] == "href" and i < len(t) and t[i] == "{":
            i = _group(t, i)  # the address; its text follows and is read on
        elif m[1] == "textbackslash":
            out.append("\\")
        elif i < len(t) and t[i] == " ":
            i += 1
    return "".join(out).replace("``", '"').replace("''", '"')


# ---- segments -----------------------------------------------------------------------------------------------------


class _Keep:
    """Collects elements; stands in for them while the rest is cleaned."""

    def __init__(self):
        self.elements: list[tuple[str, str]] = []
        self.shown: list[str] = []

    def __call__(self, element: str | None, content: str, shown: str) -> str:
        if element and content:
            self.elements.append((element, content))
        self.shown.append(shown)
        return f"\x05{len(self.shown) - 1}\x06"

    def restore(self, t: str) -> str:
        n = 1
        while n:  # what is shown holds only what was shown before it
            t, n = re.subn("\x05(\\d+)\x06", lambda m: self.shown[int(m[1])], t)
        return t


def _segment(t: str, kind: str, pieces: list[_Piece]) -> tuple[str, list[tuple[str, str]]]:
    keep = _Keep()

    def piece(m: re.Match) -> str:
        p = pieces[int(m[1])]
        if p.what == "drop":
            return "\n"
        if p.what == "code":
            body = p.body
            if kind == "html":
                body = html.unescape(_ANY_TAG.sub("", body) if re.match(r"\s*<code\b", body, re.I) else body)
            elif p.kind is None:
                body = re.sub(r"\A\s*<code\b[^>]*>|</code\s*>\s*\Z|\A\s*<nowiki>|</nowiki>\s*\Z", "", body, flags=re.I)
            return keep("code", squeeze(body), f"\n\n```\n{body.strip(chr(10))}\n```\n\n")
        if p.what == "dollar" and kind not in ("markdown", "latex"):
            return f"$${p.body}$$"
        body = re.sub(r"\\label\{[^}]*\}", "", p.body) if p.kind == "latex" else p.body
        return keep("formula", squeeze(body), f"$${squeeze(body)}$$")

    inline = {"html": _inline_html, "wiki": _inline_wiki, "markdown": _inline_markdown, "latex": _inline_latex}[kind]
    plain = lambda s: squeeze(keep.restore(inline(s)))
    heading = lambda level, s: keep("heading", (x := plain(s)), f"\n\n{'#' * level} {x}\n\n")
    item = lambda s: keep("list_item", (x := plain(s)), f"\n- {x}")

    if kind == "markdown":  # code spans hide what looks like a formula
        t = re.sub(r"(?<![`\\])(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)", lambda m: keep(None, "", m[2].strip()), t)
    t = re.sub(_P, piece, t)
    if kind in ("markdown", "latex"):
        t = re.sub(r"\\\[((?:(?!\\\[).)+?)\\\]|\\\(((?:(?!\\\().)+?)\\\)", lambda m: keep("formula", squeeze(m[1] or m[2]), f"${squeeze(m[1] or m[2])}$"), t, flags=re.S)
        t = _DOLLAR.sub(lambda m: keep("formula", squeeze(m[1]), m[0]), t)
    if kind == "html":
        t = _COMMENT.sub("", t)
        t = re.sub(r"<h([1-6])\b[^>]*>(.*?)(?:</h[1-6]\s*>|(?=<h[1-6]\b)|\n[ \t]*\n|\Z)", lambda m: heading(int(m[1]), m[2]), t, flags=re.S | re.I)
        t = re.sub(r"<li\b[^>]*>(.*?)(?:</li\s*>|(?=<li\b|</?[uo]l\b)|\n[ \t]*\n|\Z)", lambda m: item(m[1]), t, flags=re.S | re.I)
    elif kind == "wiki":
        t = re.sub(r"(?m)^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", lambda m: heading(len(m[1]), m[2]), t)
        t = re.sub(r"(?m)^[*#]+[ \t]*([^\s*#][^\n]*)$", lambda m: item(m[1]), t)
    elif kind == "markdown":
        t = re.sub(r"(?m)^[ ]{0,3}>[ ]?", "", t)
        t = re.sub(r"(?m)^[ ]{0,3}(#{1,6})[ \t]+([^\n]*?)(?:[ \t]+#+)?[ \t]*$", lambda m: heading(len(m[1]), m[2]), t)
        t = re.sub(r"(?m)^[ ]{0,3}([^\s>\x05*+-][^\n]*|[*_][^\s][^\n]*|\x05[^\n]*)\n[ ]{0,3}(={2,}|-{2,})[ \t]*$", lambda m: heading(1 if m[2][0] == "=" else 2, m[1]), t)
        t = re.sub(r"(?m)^[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", "", t)
        t = re.sub(r"(?m)^[ \t]*(?:[*+-]|\d{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?([^\n]+(?:\n(?![ \t]*(?:[*+-]|\d{1,9}[.)])[ \t])[ \t]+[^\s][^\n]*)*)", lambda m: item(m[1]), t)
    else:
        t = re.sub(r"(?<!\\)%[^\n]*", "", t)
        t = _latex_headings(t, heading)
        t = re.sub(r"\\item\b[ \t]*(?:\[([^\]\n]*)\])?[ \t]*(.*?)(?=\\item\b|\\(?:begin|end)\{|\n[ \t]*\n|\Z)", lambda m: item(f"{m[1]} {m[2]}" if m[1] else m[2]), t, flags=re.S)
    return keep.restore(inline(t)), keep.elements


def _latex_headings(t: str, heading) -> str:
    out, last = [], 0
    for m in re.finditer(r"\\(chapter|part|section|subsection|subsubsection|paragraph|subparagraph|title)\*?\s*(?:\[[^\]\n]*\])?\s*\{", t):
        if m.start() < last:
            continue
        end = _group(t, m.end() - 1)
        level = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4}.get(m[1], 5)
        out += [t[last : m.start()], heading(level, t[m.end() : end - 1])]
        last = end
    return "".join([*out, t[last:]])


def clean(text: str | None, weights: dict[str, float] | None = None) -> tuple[str, list[str], list[tuple[str, str, str]]]:
    """(clean text, kinds, elements (kind, element, content)) of one document."""
    if not text or not text.strip():
        return "", [], []
    body, pieces = _protect(text.replace("\r\n", "\n"))
    lo, hi = content_region(body, pieces, weights or _WEIGHTS)
    spans, at = [], 0
    for m in re.finditer(r"\n[ \t]*\n", body):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(body)))
    blocks = [body[a:b] for a, b in spans]
    kinds = _kinds(blocks, pieces)
    seen, elements, shown = [], [], []
    k = 0
    while k < len(blocks):
        j = k
        while j < len(blocks) and kinds[j] == kinds[k]:
            j += 1
        if kinds[k] and any(_marked(b, kinds[k], pieces) for b in blocks[k:j]) and kinds[k] not in seen:
            seen.append(kinds[k])
        part = body[max(lo, spans[k][0]) : min(hi, spans[j - 1][1])]
        if part.strip():
            if kinds[k]:
                shown_part, found = _segment(part, kinds[k], pieces)
                elements += [(kinds[k], e, c) for e, c in found]
            else:
                shown_part = part
            shown.append(shown_part.strip())
        k = j
    out = re.sub(r"[ \t]+\n", "\n", "\n\n".join(s for s in shown if s))
    return re.sub(r"\n{3,}", "\n\n", re.sub("[\x01-\x06]", "", out)).strip(), [k for k in KINDS if k in seen], elements


def _marked(block: str, kind: str, pieces: list[_Piece]) -> bool:
    sure, may = _proof(block, pieces)
    return kind in sure or kind in may


def clean_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "content", weights: dict[str, float] | None = None) -> DataFrame:
    """(id, clean, kinds, elements): one narrow stage, no shuffle; a row's work is linear in its text."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            got = [clean(t, weights) for t in pdf["t"]]
            yield pd.DataFrame({id_col: pdf["i"].to_numpy(dtype=object), "clean": [g[0] for g in got], "kinds": [g[1] for g in got], "elements": [[{"kind": k, "element": e, "content": c} for k, e, c in g[2]] for g in got]})

    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(run, f"`{id_col}` string, clean string, kinds array<string>, elements array<struct<kind:string,element:string,content:string>>")


def found_elements(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, kind, element, content): a `document` row per kind, and every element, each once."""
    whole = F.transform("kinds", lambda k: F.struct(k.alias("kind"), F.lit("document").alias("element"), F.lit("").alias("content")))
    rows = cleaned.select(id_col, F.explode(F.concat(whole, F.col("elements"))).alias("e"))
    return rows.select(id_col, "e.kind", "e.element", "e.content").distinct()
