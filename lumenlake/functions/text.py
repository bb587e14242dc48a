"""Text expressions: ASCII case folding, the full-text tokenizer, display titles, small formats."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def nocase(c: Column | str) -> Column:
    """Folds A-Z only, as the catalogue's NOCASE order does."""
    return F.translate(c, _UPPER, _LOWER)


@lru_cache(maxsize=1)
def _marks() -> tuple[str, str]:
    """Precomposed Latin, Greek and Cyrillic letters, and what is left of each without its marks."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column | str) -> Column:
    """Lower case without diacritics."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.octet_length(c) == F.length(c)  # ASCII has no marks
    return F.when(plain, F.lower(c)).otherwise(F.regexp_replace(F.translate(F.lower(c), *_marks()), r"\p{Mn}+", ""))


def tokens(c: Column | str) -> Column:
    """The full-text tokens: runs of letters and numbers, folded."""
    return F.regexp_extract_all(F.coalesce(folded(c), F.lit("")), F.lit(TOKEN), F.lit(0))


def query_tokens(word: str) -> list[str]:
    """The same tokenizer on the driver, for query words."""
    low = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", low)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean(c: Column | str) -> Column:
    """Trimmed, without NUL characters; blank is null."""
    return blank_to_null(F.translate(c, "\0", ""))


def display_title(user_title: Column, caption: Column, file_name: Column) -> tuple[Column, Column]:
    """The title shown and where it comes from: 2 user, 1 caption, 0 file name."""
    user, ai = blank_to_null(user_title), blank_to_null(caption)
    return F.coalesce(user, ai, file_name), F.when(user.isNotNull(), 2).when(ai.isNotNull(), 1).otherwise(0)


def shutter(seconds: Column) -> Column:
    """2s, 1.5s or 1/250; null for nothing or nonsense."""
    whole = F.regexp_replace(F.format_string("%.1f", seconds), r"\.0$", "")
    return F.when(seconds >= 1, F.concat(whole, F.lit("s"))).when(seconds > 0, F.concat(F.lit("1/"), F.bround(1 / seconds).cast("long").cast("string")))


def sentences(c: Column, shortest: int = 12, most: int = 8) -> Column:
    """The first sentences of a caption that are long enough to embed."""
    parts = F.transform(F.split(c, r"[.!?\n]"), lambda s: F.trim(s))
    return F.slice(F.filter(parts, lambda s: F.char_length(s) >= shortest), 1, most)


def tidy(raw: Column) -> Column:
    """A generated description without end marks, cut at its last full stop if that is past half."""
    text = F.trim(F.regexp_replace(raw, r"<\|im_end\|>|<\|endoftext\|>", ""))
    last = F.char_length(F.regexp_extract(text, r"(?s)^(.*[.!?])", 1))
    cut = (last > 1) & (last < F.char_length(text)) & (last - 1 > F.floor(F.char_length(text) / 2))
    text = F.when(cut, F.substring(text, F.lit(1), last)).otherwise(text)
    return F.nullif(F.regexp_replace(text, r"\.{2,}$", "."), F.lit(""))


def until_repeat(text: Column, shortest: int = 12) -> Column:
    """Keeps sentences (each ends in a full stop) up to the first longer one that was said before,
    ignoring case; what follows the last full stop stays only if nothing was repeated."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)[^.]*\."), F.lit(0))
    rest = F.regexp_extract(text, r"(?s)([^.]*)$", 1)
    state = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("over"))

    def step(a, s):
        said = F.lower(F.trim(s))
        again = a["over"] | ((F.char_length(said) > shortest) & F.array_contains(a["seen"], said))
        return F.struct(F.when(again, a["out"]).otherwise(F.concat(a["out"], s)).alias("out"), F.when(again, a["seen"]).otherwise(F.array_append(a["seen"], said)).alias("seen"), again.alias("over"))

    return F.aggregate(parts, state, step, lambda a: F.when(a["over"], a["out"]).otherwise(F.concat(a["out"], rest)))
