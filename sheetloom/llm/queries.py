"""The registered queries of this subpackage and their SQL."""

from sheetloom.llm import align, ann, audit, html, licenses, lines, mixing, ngrams, online, packing, quality, secrets, tokenfile

MODULES = (ngrams, ann, secrets, lines, mixing, quality, tokenfile, packing, licenses, html, audit, online, align)
