"""Scalar text expressions, all built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import constants as C

# White space as Unicode text knows it, wider than the ASCII class of a regex.
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WS_SET = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{_WS_SET}]"
NON_WS = f"[^{_WS_SET}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WS_CHARS))


# The Latin-1 part of the class compiles to a bit set, several times faster than the full one.
_WORD_LATIN = r"[^ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0]+"
# First UTF-8 bytes of the characters that only the full class knows.
_WIDE_LEADS = (b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")


def word_count(c: Column | str) -> Column:
    """Words between white space. Only texts that may hold wide spaces take the slow pattern."""
    wide = F.lit(False)
    for lead in _WIDE_LEADS:
        wide = wide | F.contains(_col(c).cast("binary"), F.lit(bytearray(lead)))
    full = F.regexp_count(_col(c), F.lit(rf"{NON_WS}+"))
    return F.when(wide, full).otherwise(F.regexp_count(_col(c), F.lit(_WORD_LATIN))).cast("bigint")


def clean_text(c: Column | str) -> Column:
    """Drop NUL characters; lone surrogates cannot occur in a Spark string."""
    return F.replace(_col(c), F.lit("\x00"), F.lit(""))


def clean_metadata(m: Column | str) -> Column:
    """Null values of a string map become empty strings."""
    return F.transform_values(_col(m), lambda _, v: F.coalesce(v, F.lit("")))


def clean_field(c: Column | str) -> Column:
    """A metadata column as text, null as empty."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def field(m: Column | str, key: str, default: str) -> Column:
    """Value of a metadata map with a default for a missing key."""
    return F.coalesce(F.try_element_at(_col(m), F.lit(key)), F.lit(default))


def normalise_query(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), rf"{WS}+", " "))


def expand_query(c: Column | str) -> Column:
    """Short questions get two more words to search with."""
    short = word_count(c) < C.SHORT_QUERY_WORDS
    return F.when(short, F.concat(_col(c), F.lit(C.SHORT_QUERY_SUFFIX))).otherwise(_col(c))


def chunk_id(content: Column | str, counter: Column | str) -> Column:
    return F.substring(F.md5(F.concat(_col(content), _col(counter).cast("string"))), 1, 16)


def embedding_key(text: Column | str, model: str = "default") -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), F.lower(strip(text))), 256)


def response_key(query: Column | str, top_contents: Column | str) -> Column:
    """Key of an answer: the question and the first 200 characters of each of the top contents.

    ``top_contents`` is an array, best first, of at most three contents.
    """
    heads = F.transform(_col(top_contents), lambda t: F.substring(t, 1, 200))
    digest = F.substring(F.sha2(F.array_join(heads, ""), 256), 1, 16)
    digest = F.when(F.size(_col(top_contents)) > 0, digest).otherwise(F.lit(""))
    return F.sha2(F.concat(strip(F.lower(_col(query))), F.lit("_"), digest), 256)


def unquote(c: Column | str) -> Column:
    """Percent-decoding that keeps a plus sign and leaves a broken escape as it is."""
    safe = F.regexp_replace(_col(c), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), _col(c))


def base_name(c: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(_col(c), r"(/\.?)+\z", ""), r"[^/]*\z", 0)


def safe_filename(c: Column | str) -> Column:
    """File name without path or unsafe characters; null when nothing safe is left."""
    unsafe = C.UNSAFE_FILENAME_CHARS
    name = F.translate(base_name(clean_text(unquote(c))), unsafe, "_" * len(unsafe))
    return F.when((name != "") & ~F.startswith(name, F.lit(".")), name)


def file_extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"[^/](\.[^./]+)\z", 1))


def preview(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def similarity(distance: Column | str) -> Column:
    return F.lit(1.0) - _col(distance)


def upload_id(filename: Column | str, position: Column | str) -> Column:
    return F.concat_ws("_", F.lit("upload"), _col(filename), _col(position).cast("string"))


def fenced_answer(answer: Column | str, language: str = "python") -> Column:
    """Wrap an answer in a code fence unless it has one."""
    wrapped = F.concat(F.lit(f"{C.FENCE}{language}\n"), _col(answer), F.lit(f"\n{C.FENCE}"))
    return F.when(F.contains(_col(answer), F.lit(C.FENCE)), _col(answer)).otherwise(wrapped)


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp")) / F.lit(1e6)


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(seconds))


def topic(query: Column | str) -> Column:
    """Topic of a question by the words it contains."""
    text = F.lower(_col(query))
    out: Column | None = None
    for name, words in C.TOPIC_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def batch_tier(mean_length: Column | str) -> Column:
    """Batch size for texts of a mean length; null mean (no texts) has its own size."""
    mean = _col(mean_length)
    out = F.when(mean.isNull(), C.BATCH_TIER_EMPTY)
    for below, batch in C.BATCH_TIERS:
        out = out.when(mean < below, batch)
    return out.otherwise(C.BATCH_TIER_LONG)


def technology_name(key: Column | str, default: str | None = C.DEFAULT_TECHNOLOGY) -> Column:
    """Display name from the fixed table of nine, as a literal map: nothing to join."""
    pairs = [F.lit(x) for kv in C.TECHNOLOGIES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(key)), F.lit(default))
