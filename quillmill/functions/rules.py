"""Patterns and tables that decide results. They are stated as they apply, in their order of use."""

ARTEFACTS = {
    "email_addresses": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "urls": r"https?://[^\s]+|ftp://[^\s]+|www\.[^\s]+",
    "doi_references": r"\bdoi:\s*[\w\./\-]+|\b10\.\d{4,}/[^\s]+",
    "isbn_references": r"\bISBN[-\s]*:?\s*[\d\-xX]+",
    "arxiv_references": r"\barXiv:\s*[\w\./\-]+",
}
_NAME = r"[A-Z][A-Za-z'-]+(?:\s+(?:and|et)\s+[A-Z][A-Za-z'-]+)?(?:,\s*Jr\.?)?(?: et al\.)?,\s*\d{4}[a-z]?"
#: Citations that are always accepted. Groups that repeat are possessive: Java runs those as a loop, others on its stack.
CITATIONS = {
    "square_numeric": r"\[\s*+\d++(?:,\s*+\d++)*+\s*+(?:-\s*+\d++)?+\s*+\]",
    "consecutive_numeric": r"(?:\(\s*+\d++\s*+\)){2,}+",
    "author_year_multi": r"\((?:" + _NAME + r"\s*;\s*)++" + _NAME + r"\)",
    "author_year_single": r"\(" + _NAME + r"\)",
}
#: Texts without any of these hold no match of the pattern.
LITERALS = {
    "email_addresses": ("@",), "urls": ("://", "www."), "doi_references": ("doi:", "10."), "isbn_references": ("ISBN",), "arxiv_references": ("arXiv",),
    "square_numeric": ("[",), "consecutive_numeric": ("(",), "author_year_multi": ("(",), "author_year_single": ("(",),
}
#: White space at the ends of lines and texts.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT_LINE = r"(?i)^(?:keywords?:\s+.*|(?:table|figure|chapter)\s+\d+|p\.?\s*\d+|[\d\s.,;\-()]+)$"
METADATA_KEYWORDS, METADATA_CODE, METADATA_CAPS = r"^[Kk]eywords?:\s+", r"^[A-Z0-9\-]{2,}\s+[A-Z0-9\-]{2,}", r"^[A-Z0-9\s\-\.]+$"
COPYRIGHT = r"(?i)©|copyright|\(c\)|all rights reserved"
CAPTION = r"(?i)^(?:fig|figure|tab|table|tbl)\.?\s*\d+(?:\.\d+)?[\s:]*"
NUMERIC_WORD = r"^\d+\.?\d*$"
MATHS = r"[αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ∂∇∑∏∫≡≠≤≥±∓×÷∈∉⊂⊃∪∩†‡°µℋℰℱℊℌℍℎℏℐ]|⟨[^⟩]*⟩|\|[^|]*⟩|⟨[^|]*\||[a-zA-Z]+_[a-zA-Z0-9]+|[a-zA-Z]+\^[a-zA-Z0-9]+|\\[a-z]+\{[^}]*\}|[a-zA-Z]+=.*[a-zA-Z]"
#: Symbols and what takes their place, one sign each or several.
SYMBOLS = {
    "⁢": "", "⁣": "", "⁡": "",
    "−": "-", "‐": "-", "–": "-", "—": "-",
    ": \"'\", r": "'", "‚": ",", "„": '"', "‹": "<", "›": ">", "«": "<<", "»": ">>", "❛": "'", "❜": "'", "❝": '"', "❞": '"',
    "•": "*", "‣": "*", "‧": "*", "⁃": "*", "◦": "*", "⁌": "*", "⁍": "*",
    "→": "->", "←": "<-", "↔": "<->", "⇒": "=>", "⇐": "<=", "⇔": "<=>", "⟶": "-->", "⟵": "<--", "⟷": "<-->",
    "©": "(c)", "®": "(R)", "™": "(TM)", "§": "section", "¶": "paragraph",
    "′": "'", "″": "''", "…": "...", "⋯": "...",
}
#: Latin letters in place of Cyrillic ones that look alike. Texts in Cyrillic are changed too.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "А": "A", "В": "B", "Е": "E",
    "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "и": "u",
    "н": "h", "т": "t", "ь": "b",
}
#: Signs of words and of white space as the rules mean them, for engines that know ASCII only by \w and \s.
_W, _S = r"[\p{L}\p{N}_]", r"\s\x0b\x1c-\x1f\x85\p{Z}"
#: Entries of tables of contents and tables, removed in this order; those from \A to \z must be the whole text.
CONTENTS = {
    "dotted_entry": (_W + r"+[." + _S + r"]{5,}\p{Nd}+", ""),
    "only_dots": (r"\A[.\t" + _S + r"]{10,}\z", ""),
    "dotted_title": (_W + r"+[.\t]{5,}" + _W + "+", ""),
    "only_numbers": (r"\A[\p{Nd}." + _S + r"]{20,}\z", ""),
    "tab_separated": (r"\A[^\n\t]*\t[^\n\t]*\t[^\n\t]*\t[^\n]*(\n?)\z", "$1"),
}
#: Letters whose capital Spark writes as several signs, or knows by a newer Unicode than DuckDB, with the one sign that
#: takes their place in DuckDB's upper(): a capital or title letter, or themselves.
UPPER = {c: "\u1e9e" if c == "\xdf" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1}
UPPER |= {chr(i): chr(i) for i in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))}
SPACED_DOTS, MANY_DOTS = r"(?:\. ){3,}", r"\.{4,}"
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
LANGUAGE_THRESHOLD, RECOVERY = 0.75, (0.70, 0.75)
