"""Text as Columns: composing, cleaning, tokenizing. No Python runs on the executors.

Java's regular expressions follow Python's here: (?U) for Unicode classes, (?d) so that only
a line feed ends a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What issue templates put into every body, in the order of removal, with what replaces it.
BOILERPLATE = (
    (r"(?is)<details>.*?</details>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?imdU)^\s*Type:\s*<b>.*?</b>\s*$", ""),
    (r"(?imdU)^\s*(?:VS Code version|Extension version|OS version|Modes|Remote OS version|Local OS version|Extension Host Version|Steps to Reproduce)\s*:.*$", ""),
    (r"\n{3,}", "\n\n"),
)
#: Fixed value: characters that tok_atomic strips from both ends of a chunk.
TRIMMED = "\"'`(),.:;!?[]{}<>*#|"
#: Fixed value: white space by Unicode, the same characters as (?U)\s.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends included. A regular expression would try every run of white space in the text."""
    return F.btrim(c, F.lit(SPACES))


def without_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\0"), F.lit(""))


def strip_boilerplate(body: Column) -> Column:
    """The body without template parts; null is empty."""
    out = F.coalesce(body, F.lit(""))
    for pattern, replacement in BOILERPLATE:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


def issue_text(title: Column, body: Column, max_chars: int = 8000, clean: bool = False) -> Column:
    """Title and body, trimmed, the empty ones left out, with a blank line between, cut at max_chars."""
    body = strip_boilerplate(body) if clean else strip(body)
    filled = lambda c: F.when(F.length(c) > 0, c)
    return F.substring(F.concat_ws("\n\n", filled(strip(title)), filled(body)), 1, max_chars)


def snippet(title: Column, body: Column, chars: int = 600) -> Column:
    """Cleaned text cut at chars, then without as many characters as the raw title has."""
    text = issue_text(title, body, chars, clean=True)
    return strip(F.substring(text, F.length(F.coalesce(title, F.lit(""))) + 1, F.lit(chars)))


def query_text(text: Column) -> Column:
    """A typed query: its first line as it is, the rest cleaned."""
    rest = F.substring(text, F.instr(text, "\n") + 1, F.length(text))
    return F.when(F.instr(text, "\n") > 0, issue_text(F.split_part(text, F.lit("\n"), F.lit(1)), rest, clean=True)).otherwise(strip(text))


def naive_utc(c: Column) -> Column:
    """An ISO string as a timestamp without time zone, in UTC whatever the session's zone; one without an offset is in UTC."""
    seconds = F.unix_micros(F.to_timestamp(c)).cast("decimal(24,6)") / F.lit(1000000)
    moved = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.when(c.rlike(r"(?:Z|[+-]\d\d(?::?\d\d)?)$"), moved).otherwise(F.to_timestamp_ntz(c))


def tok_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def tok_atomic(text: Column) -> Column:
    """Chunks between white space, stripped of punctuation at both ends."""
    chunks = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), 0)
    return F.filter(F.transform(chunks, lambda x: F.btrim(x, F.lit(TRIMMED))), lambda x: x != "")


def tok_both(text: Column) -> Column:
    """Each chunk, followed by its parts where it has several."""
    parts = lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), 0)
    return F.flatten(F.transform(tok_atomic(text), lambda x: F.when(F.size(parts(x)) > 1, F.concat(F.array(x), parts(x))).otherwise(F.array(x))))


TOKENIZERS = {"atomic": tok_atomic, "words": tok_words, "both": tok_both}
