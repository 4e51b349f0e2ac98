"""Text cleaning and tokenising as JVM-side column expressions (whole-stage codegen, no UDF).

Python's ``\\w``/``\\s``/``\\d`` are Unicode classes while Java's and RE2's are ASCII, so every
class is spelled out with Unicode properties; the same spelling works in Spark (Java regex)
and in DuckDB (RE2), which the oracle SQL relies on.  Java patterns use possessive loops so a
100,000-character literal or comment cannot overflow the regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for equal results)
#   word character:        letters, numbers, underscore (Python's Unicode \w)
#   space character:       Python's Unicode \s
#   C operators kept whole: ++ -- && || -> == >= <= != >> <<
#   number token:          starts with 0x<hex> or a decimal digit -> <NUM>
#   string literal token:  <STR>
#   comment replacement:   one space
#   string replacement:    " <placeholder> " (one space either side)
#   corpus line end:       " <EOF>"
#   count-vectoriser token: two or more word characters, lower-cased
#   attribute name:        feat_<name, non-word characters -> _>_<index>
#   fix-commit URL:        .*?(github\.com|git\.kernel\.org).*?torvalds.*?(commit)+.*?(h=|/)+([a-z0-9]+)
#                          matched at the start, hash = group 4, reference source CONFIRM
#   file names in text:    \b[0-9A-Za-z_/]+\.c\b
#   function names:        \b([0-9A-Za-z_]+)\s+(function|implementation)\s+in   (group 1)
# ---------------------------------------------------------------------------------------------
WORD = r"\p{L}\p{N}_"
SPACE = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
OPERATORS = ["++", "--", "&&", "||", "->", "==", ">=", "<=", "!=", ">>", "<<"]
NUM_TOKEN = "<NUM>"
STR_TOKEN = "<STR>"
STRING_PLACEHOLDER = "QQSTRINGLITERALQQ"
EOF_TOKEN = "<EOF>"
FIX_COMMIT_URL = r"^.*?(github\.com|git\.kernel\.org).*?torvalds.*?(commit)+.*?(h=|/)+([a-z0-9]+)"
FIX_COMMIT_GROUP = 4
FIX_COMMIT_SOURCE = "CONFIRM"

# tokenisers (same spelling in Java and RE2)
NAIVE_TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]"
_OPS = "|".join("".join("\\" + ch if ch in "+|" else ch for ch in op) for op in OPERATORS)
OPS_TOKEN = rf"{_OPS}|[#{WORD}]+|[^#{WORD}{SPACE}]"
NUM_PREFIX = r"^(0x[0-9a-fA-F]+|\p{Nd}+)"
COUNT_TOKEN = rf"[{WORD}]{{2,}}"
NON_WORD = rf"[^{WORD}]"

# comments / literals: Java (possessive) and RE2 spellings of the same language
_J_DQ = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_J_SQ = r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"
_J_LINE = r"//[^\n]*+"
_J_BLOCK = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
J_COMMENTS = rf"(?s)({_J_DQ}|{_J_SQ})|{_J_LINE}|{_J_BLOCK}"
J_LITERAL_SPACE = rf"(?s)({_J_DQ}|{_J_SQ}) "
J_STRING = r'"[^"]*+"'

_R_DQ = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_R_SQ = r"'[^'\\]*(?:\\.[^'\\]*)*'"
R_COMMENTS = rf"(?s)({_R_DQ}|{_R_SQ})|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
R_LITERAL_SPACE = rf"(?s)({_R_DQ}|{_R_SQ}) "
R_STRING = r'"[^"]*"'

# description matches: Python's Unicode \b spelled with look-arounds (Java only)
_B_BEFORE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
DESC_FILE = rf"{_B_BEFORE}[0-9A-Za-z_/]+\.c(?![{WORD}])"
DESC_FUNCTION = rf"(?<![{WORD}])([0-9A-Za-z_]+)[{SPACE}]+(function|implementation)[{SPACE}]+in"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenise(text) -> Column:
    """``fn_tokenise``: word runs and single non-space symbols, then :func:`normalise`."""
    return normalise_tokens(F.regexp_extract_all(_c(text), F.lit(NAIVE_TOKEN), 0))


def tokenise_raw(text) -> Column:
    """Naive tokens without normalisation."""
    return F.regexp_extract_all(_c(text), F.lit(NAIVE_TOKEN), 0)


def tokenise_ops(text) -> Column:
    """``fn_tokenise_ops``: C operators kept whole, ``#`` joins words, else one symbol."""
    return F.regexp_extract_all(_c(text), F.lit(OPS_TOKEN), 0)


def normalise(token) -> Column:
    """``fn_normalise`` for one token column."""
    t = _c(token)
    # NUM_PREFIX matches exactly the tokens whose first character is a decimal digit ("0x.." starts
    # with 0), so only that character is tested
    return (
        F.when(F.substring(t, 1, 1).rlike(r"^\p{Nd}$"), F.lit(NUM_TOKEN))
        .when(t == F.lit(STRING_PLACEHOLDER), F.lit(STR_TOKEN))
        .otherwise(t)
    )


def normalise_tokens(tokens) -> Column:
    """``fn_normalise`` over an array of tokens."""
    return F.transform(_c(tokens), normalise)


def strip_comments(text) -> Column:
    """``fn_strip_comments``: C/C++ comments -> one space; string and char literals untouched.

    Pass one turns each comment into a space and appends a space to each literal; pass two finds
    the same literals again (nothing before them changed in a way that moves a literal start) and
    removes the appended space, so the output equals the single-pass reference result exactly.
    """
    once = F.regexp_replace(_c(text), F.lit(J_COMMENTS), F.lit("$1 "))
    return F.regexp_replace(once, F.lit(J_LITERAL_SPACE), F.lit("$1"))


def replace_strings(text, c_escapes: bool = False) -> Column:
    """``fn_replace_strings``: every ``"..."`` becomes `` <placeholder> ``.  By default a literal
    stops at the next quote, escaped or not (the reference's effective rule); ``c_escapes=True``
    honours backslash escapes as C does."""
    pattern = _J_DQ if c_escapes else J_STRING
    return F.regexp_replace(_c(text), F.lit(pattern), F.lit(f" {STRING_PLACEHOLDER} "))


def denoise_tokens(code) -> Column:
    """Comments -> strings -> operator-aware tokens -> normalised tokens (array)."""
    return normalise_tokens(tokenise_ops(replace_strings(strip_comments(code))))


def denoise(code) -> Column:
    """``fn_denoise``: the cleaned code as one space-separated token string."""
    return F.array_join(denoise_tokens(code), " ")


def corpus_line(code) -> Column:
    """``snk_corpus`` line: denoised document terminated by `` <EOF>``."""
    return F.concat(denoise(code), F.lit(" " + EOF_TOKEN))


def count_tokens(text) -> Column:
    """``fn_count_tokens``: the count-vectoriser's default tokens (lower-cased, >= 2 word chars)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(COUNT_TOKEN), 0)


def attr_name(name, idx) -> Column:
    """``fn_attr_name``: ``feat_<name with non-word -> _>_<idx>``."""
    return F.concat(F.lit("feat_"), F.regexp_replace(_c(name), F.lit(NON_WORD), F.lit("_")), F.lit("_"), _c(idx).cast("string"))


def find_desc_files(text) -> Column:
    """``fn_find_all``: ``.c`` file names mentioned in free text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(DESC_FILE), 0)


def find_desc_functions(text) -> Column:
    """``fn_find_all``: names before "function in" / "implementation in", in order."""
    return F.regexp_extract_all(_c(text), F.lit(DESC_FUNCTION), 1)


def fix_commit_hash(url) -> Column:
    """``flt_confirm_fix`` projection: hash (group 4) of a fix-commit URL, null if no match."""
    u = _c(url)
    return F.when(u.rlike(FIX_COMMIT_URL), F.regexp_extract(u, FIX_COMMIT_URL, FIX_COMMIT_GROUP))


def split_lines(text) -> Column:
    """Lines of a text split on ``\\n`` exactly (the empty tail after a final newline counts)."""
    return F.split(_c(text), "\n", -1)
