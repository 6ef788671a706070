"""Column expressions over text (all JVM-side, inside whole-stage codegen).

Fixed values that must equal the reference's behaviour are listed together
below; everything else is plain ``pyspark.sql.functions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
METASPACE = "▁"                       # the word-boundary marker "▁"
# Article title: ' = Title = \n' but not ' = = Sub = = \n' nor a 1-char title.
TITLE_PATTERN = r"^\s=\s[^=].*[^=]\s=\s\n$"
# Chat tags of the post-training profile.
SYSTEM_OPEN, SYSTEM_CLOSE = "<SYSTEM>", "</SYSTEM>"
USER_OPEN, USER_CLOSE = "<USER>", "</USER>"
MODEL_OPEN, MODEL_CLOSE = "<MODEL>", "</MODEL>"
# Python's str.split()/strip() whitespace: Unicode White_Space plus \x1c-\x1f.
WS = r"(?U)[\s\x1c-\x1f]"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_whitespace(text) -> Column:
    """``' '.join(s.split())`` - one line, single spaces, trimmed."""
    return F.regexp_replace(F.regexp_replace(_c(text), WS + "+", " "), "^ | $", "")


def is_blank(text) -> Column:
    """C2 predicate: empty after stripping whitespace."""
    return F.regexp_replace(_c(text), WS + "+", "") == ""


def strip(text) -> Column:
    """Python ``str.strip()`` (trim() only strips spaces)."""
    return F.regexp_replace(_c(text), f"^{WS}+|{WS}+$", "")


def words(text) -> Column:
    """Python ``s.split()`` as an array."""
    return F.filter(F.split(_c(text), WS + "+"), lambda w: w != "")


def metaspace(text) -> Column:
    """C5 normalisation: spaces become '▁', and a '▁' is prepended when absent."""
    s = F.replace(_c(text), F.lit(" "), F.lit(METASPACE))
    return F.when(s.startswith(METASPACE), s).otherwise(F.concat(F.lit(METASPACE), s))


def metaspace_pieces(text) -> Column:
    """Split before every '▁' (only U+0020 is a boundary); an empty text has
    no piece. "a b\\nc" -> [▁a, ▁b\\nc]; "a  b" -> [▁a, ▁, ▁b]."""
    return F.when(_c(text) == "", F.array().cast("array<string>")).otherwise(
        F.split(metaspace(text), f"(?={METASPACE})"))


def specials_pattern(specials: Sequence[str]) -> str:
    import re
    return "(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")"


def pieces_with_specials(text, specials: Sequence[str]) -> Column:
    """T1 pre-tokenisation with added tokens: special tokens are cut out first,
    every other non-empty segment gets its own metaspace pieces."""
    if not specials:
        return metaspace_pieces(text)
    # a special token, or a run up to the next one (no separator character in the text)
    sp = specials_pattern(specials)
    segs = F.regexp_extract_all(_c(text), F.lit(f"(?s){sp}|.+?(?={sp}|\\z)"), 0)
    sp = F.array(*[F.lit(s) for s in specials])
    return F.flatten(F.transform(
        segs, lambda s: F.when(F.array_contains(sp, s), F.array(s)).otherwise(metaspace_pieces(s))))


def chars(text) -> Column:
    """Code points of ``text`` as an array of one-character strings."""
    return F.regexp_extract_all(_c(text), F.lit("(?s)."), 0)


def is_title(text) -> Column:
    """Article title line, with Python's white space and line ends (only
    "\\n" ends a line)."""
    return _c(text).rlike("(?Ud)" + TITLE_PATTERN.replace(r"\s", r"[\s\x1c-\x1f]"))


def chunk_words(text, n: int | None) -> Column:
    """Every ``n`` words re-joined with one space (array of chunks; empty
    text gives no chunk; n = 0/None keeps the text as the only chunk)."""
    if not n:
        return F.array(_c(text))
    w = words(text)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(int(n))))
    return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, int(n)), " ")),
                      F.array().cast("array<string>"))


def book_text(title, author, date, pages) -> Column:
    """P2: "{title} by {author}, published {date}\\n" + pages with no separator;
    a missing field prints None."""
    def fmt(c):
        return F.coalesce(_c(c), F.lit("None"))
    return F.concat(fmt(title), F.lit(" by "), fmt(author), F.lit(", published "), fmt(date),
                    F.lit("\n"), F.array_join(_c(pages), ""))


def format_instruction(instruction, input_, output) -> tuple[Column, Column]:
    """Alpaca prompt and completion; <USER> part only for a non-empty input."""
    user = F.when(F.length(_c(input_)) > 0,
                  F.concat(F.lit(USER_OPEN), _c(input_), F.lit(USER_CLOSE))).otherwise(F.lit(""))
    prompt = F.concat(F.lit(SYSTEM_OPEN), F.coalesce(_c(instruction), F.lit("None")),
                      F.lit(SYSTEM_CLOSE), user, F.lit(MODEL_OPEN))
    completion = F.concat(F.coalesce(_c(output), F.lit("None")), F.lit(MODEL_CLOSE))
    return prompt, completion


def render_turn(role, text) -> Column:
    """P4 per message: prompter -> <USER>t</USER>, assistant -> <MODEL>t</MODEL>,
    any other role is an error."""
    r, t = _c(role), _c(text)
    return (F.when(r == "prompter", F.concat(F.lit(USER_OPEN), t, F.lit(USER_CLOSE)))
            .when(r == "assistant", F.concat(F.lit(MODEL_OPEN), t, F.lit(MODEL_CLOSE)))
            .otherwise(F.raise_error(F.concat(F.lit("Unknown role: "), F.coalesce(r, F.lit("None"))))))


def close_model(text) -> Column:
    """P5 completion: text + </MODEL>."""
    return F.concat(_c(text), F.lit(MODEL_CLOSE))


def to_json_text(text) -> Column:
    """{"text": ...} line."""
    return F.to_json(F.struct(_c(text).alias("text")))


# --- fixed values (vocabulary-training pre-split) ---------------------------
# Scripts that are kept apart, by their Unicode names; letters of any other
# script form runs of their own. Kana stands in one run with Han, as Japanese
# writes it, the long vowel mark included.
SCRIPTS = (
    "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Syriac", "Thaana", "Nko",
    "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala",
    "Thai", "Lao", "Tibetan", "Myanmar", "Georgian", "Hangul", "Ethiopic", "Cherokee", "Canadian_Aboriginal",
    "Khmer", "Mongolian", "Bopomofo", "Yi", "Tifinagh", "Coptic", "Gothic", "Glagolitic", "Runic", "Ogham",
    "Balinese", "Javanese", "Sundanese", "Tagalog", "Limbu", "Lepcha", "Vai", "Cham", "Ol_Chiki",
)
JOINED_SCRIPTS = ("Han", "Hiragana", "Katakana")
LONG_VOWEL = "\u30fc"


def script_alternatives(lead: str = "", space: str = r"\s") -> str:
    """Pattern of one piece: a run of Latin letters, a digit, a run of marks, a
    run of one other script (digits aside), a run of letters of no listed
    script, each after an optional ``lead``. Latin text stops at the first."""
    runs = [r"\p{IsLatin}+", r"\p{N}", rf"[^\p{{L}}\p{{N}}{space}]+",
            *[rf"[\p{{Is{s}}}&&[^\p{{N}}]]+" for s in SCRIPTS],
            f"[{''.join(rf'{chr(92)}p{{Is{s}}}' for s in JOINED_SCRIPTS)}{LONG_VOWEL}&&[^\\p{{N}}]]+", r"\p{L}+"]
    return "|".join(lead + r for r in runs)


BYTE_PIECE = "<0x$1>"             # a UTF-8 byte as a piece: <0xC3>
BYTE_PIECES = tuple(f"<0x{b:02X}>" for b in range(256))
# ---------------------------------------------------------------------------


def split_by_script(text) -> Column:
    """split_by_unicode_script + split_digits before vocabulary training."""
    return F.regexp_extract_all(_c(text), F.lit("(?U)" + script_alternatives()), 0)


def metaspace_script_pieces(text) -> Column:
    """C5 then C6: metaspace pieces cut into runs of one script, single digits
    and runs of marks; a '▁' stays with what follows it."""
    m = METASPACE
    pattern = f"{script_alternatives(f'{m}?', m)}|{m}"
    return F.when(_c(text) == "", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(metaspace(text), F.lit("(?s)" + pattern), 0))


def byte_pieces(ch) -> Column:
    """The UTF-8 bytes of a character as pieces '<0xNN>' (joined)."""
    return F.regexp_replace(F.hex(F.encode(_c(ch), "UTF-8")), "(..)", BYTE_PIECE)


# --- fixed values (normalisation rules) -------------------------------------
NORMALISATION_RULES = ("nfkc", "nfkc_cf", "identity")
# ---------------------------------------------------------------------------


def normalize_text(text, rule: str = "nfkc") -> Column:
    """C4: Unicode normalisation before vocabulary training. ``nfkc`` and
    ``nfkc_cf`` (NFKC then case folding) run as an Arrow-batched pandas UDF
    (Spark has no NFKC expression); ``identity`` returns the column."""
    if rule == "identity":
        return _c(text)
    if rule not in NORMALISATION_RULES:
        raise ValueError(f"unknown normalisation rule: {rule}")
    if not _NORMALISERS:
        _NORMALISERS.extend(_make_normalisers())  # built on first use (needs a session)
    nfkc, nfkc_cf = _NORMALISERS
    return nfkc_cf(_c(text)) if rule == "nfkc_cf" else nfkc(_c(text))


def _make_normalisers():
    import unicodedata

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def nfkc(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    def nfkc_cf(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    # real (not postponed) annotations: the UDF kind is read from them
    for f in (nfkc, nfkc_cf):
        f.__annotations__ = {"s": pd.Series, "return": pd.Series}
    nfkc, nfkc_cf = pandas_udf(nfkc, "string"), pandas_udf(nfkc_cf, "string")
    return nfkc, nfkc_cf


_NORMALISERS: list = []
