"""Readers of text, Markdown, HTML and DOCX files, versioned tables and remote stores."""
