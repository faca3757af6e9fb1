"""Fixed values of the citation rules: patterns in their order of use, and the words that the checks look for."""

_BRACKET_NAME = r"[\wÀ-ſЀ-ӿ一-鿿֐-׿؀-ۿ]+"
_BRACKET_CITE = _BRACKET_NAME + r"(?:\s+(?:and|et|und|y|et)\s+" + _BRACKET_NAME + r")*(?:,\s*Jr\.?)?(?: et al\.)?,\s*\d{4}[a-z]?"
_ROUND_CITE = r"[A-Z][A-Za-z'-]+(?:\s+(?:and|et)\s+[A-Z][A-Za-z'-]+)?(?:,\s*Jr\.?)?(?: et al\.)?,\s*\d{4}[a-z]?"
_LISTED = r"[A-Za-z][A-Za-z0-9\-]*(?:\s+\d+)?"
#: Fixed values. The order decides between matches that begin at one place.
PATTERNS = {
    "semicolon_blocks": r"(?:^|\s)(?:" + _LISTED + r"\s*;\s*)(?:" + _LISTED + r"\s*;\s*)*" + _LISTED + r"(?:\s*;)?(?:\s|$)",
    "square_numeric": r"\[\s*+\d++(?:,\s*+\d++)*+\s*+(?:-\s*+\d++)?\s*+\]",
    "consecutive_numeric": r"(?>\(\s*\d++\s*\)){2,}",
    "isolated_numeric": r"\(\s*\d{1,3}\s*\)(?!\s*[A-Za-z°%])",
    "author_year_multi": r"\((?:" + _ROUND_CITE + r"\s*;\s*)+" + _ROUND_CITE + r"\)",
    "author_year_single": r"\(" + _ROUND_CITE + r"\)",
    "author_year_square_single": r"\[" + _BRACKET_CITE + r"\]",
    "author_year_square_multi": r"\[(?:" + _BRACKET_CITE + r"\s*;\s*)+" + _BRACKET_CITE + r"\]",
    "ref_number": r"(?i)\b(?:ref|refs)\.?\s*\d+(?:,\s*\d+)*(?:-\s*\d+)?\b",
    "page_references": r"(?i)(?:^|\s)(?:p|pp|page|pages)\.?\s*\d+(?:-\d+)?(?:,\s*\d+(?:-\d+)?)*(?=\s|$)",
}
#: What a text must hold, in small letters, for a pattern to match at all.
NEEDS = {
    "semicolon_blocks": ";", "square_numeric": "[", "consecutive_numeric": "(", "isolated_numeric": "(",
    "author_year_multi": ";", "author_year_single": "(", "author_year_square_single": "[", "author_year_square_multi": ";",
    "ref_number": "ref", "page_references": "p",
}
#: A list of names by semicolons holds none of these.
STOPWORDS = frozenset(
    "the and or but in on at to for of with by "
    "from up about into through during before after above "
    "below between among this that these those a an as "
    "be is are was were been being have has had do "
    "does did will would could should may might must can "
    "form but however therefore thus also only just even "
    "still yet already now then here there where when "
    "why how what which who whom whose very much more "
    "most many some any each every all both either neither".split()
)
#: Text around a page reference that speaks of another place, of the document's own parts, or flows.
CITING = ("see", "cf.", "compare", "according to", "as shown in", "following", "refer to", "shown in", "presented in", "detailed in")
STRUCTURAL = ("presents", "shows", "reports", "estimates", "demonstrates", "columns", "panel", "specification", "regression", "model", "analysis", "results", "findings", "outcome")
FLOWING = ("the", "that", "this", "which", "where", "when", "how", "what", "we", "our", "using", "with", "for", "from", "on", "in", "at")
ENUMERATED = r"(?i)^\s*(\([a-zA-Z0-9]+\)|[a-zA-Z0-9]+\)|[a-zA-Z0-9]+\.|\([ivxlcdm]+\)|[ivxlcdm]+\.)\s*$"
#: A line that begins a section of tables, lists or references; all but the prose test ignore case.
SECTION_STARTS = (
    r"^table\s+\d+", r"^tab\s+\d+", r"^figure\s+\d+", r"^fig\s+\d+",
    r"^acknowledgments?$", r"^acknowledgements?$", r"^references?$", r"^bibliography$", r"^appendix", r"^supplementary",
    r"^gene\s+symbol", r"^protein\s+name", r"^antibody\s+supplier",
    r"^[A-Z][A-Z0-9]+\s+[A-Z][A-Z0-9]+\s+[A-Z][A-Z0-9]+",
)
