"""Text normalisers and hashes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_newlines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def trim_trailing_whitespace(c: Column) -> Column:
    """Spaces and tabs at line ends go."""
    return F.regexp_replace(c, r"(?dm)[ \t]+$", "")


def clip_snippet(c: Column, most: int = 120) -> Column:
    """Right-trimmed; null if empty; over ``most`` characters, cut to end in an ellipsis."""
    t = F.regexp_replace(c, r"\s+\z", "")
    return F.when(t == "", None).when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def bytes_view(c: Column) -> Column:
    """A text with one character for each UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def clip_bytes(c: Column, most: int = 80) -> Column:
    """The first line of a text, at most ``most`` bytes of it."""
    return F.substring_index(F.substring(c, 1, most), "\n", 1)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def djb2(c: Column) -> Column:
    """The djb2 hash of a text's bytes: h * 33 + byte, modulo 2**32."""
    b = F.split(bytes_view(c), "")
    return F.aggregate(F.filter(b, lambda x: x != ""), F.lit(5381).cast("long"), lambda h, x: F.pmod(h * 33 + F.ascii(x), F.lit(1 << 32)))


_WORD = 1 << 32


def _times(x: Column, y: Column) -> Column:
    """x * y modulo 2**32 in two halves, so no product leaves 64 bits."""
    return F.pmod(F.pmod(x * F.shiftright(y, 16), F.lit(1 << 16)) * (1 << 16) + x * y.bitwiseAND(F.lit(0xFFFF).cast("long")), F.lit(_WORD))


def hash_lines(c: Column, first: int, last: int) -> Column:
    """djb2 chained over all suffixes of each of the lines first to last (1-based), byte by byte.

    A byte is the map h -> 33 h + byte, so a suffix is an affine map h -> a h + b, and so is the chain of all
    suffixes. One fold from a line's end takes both along: the suffix that begins here, and the chain of it
    and those behind it. So a line costs its length, not the square of it.
    """
    start = F.struct(*[F.lit(v).cast("long").alias(k) for k, v in (("a", 1), ("b", 0), ("chain_a", 1), ("chain_b", 0))])

    def step(s: Column, byte: Column) -> Column:
        a, b = _times(s["a"], F.lit(33).cast("long")), F.pmod(_times(s["a"], F.ascii(byte).cast("long")) + s["b"], F.lit(_WORD))
        return F.struct(a.alias("a"), b.alias("b"), _times(s["chain_a"], a).alias("chain_a"), F.pmod(_times(s["chain_a"], b) + s["chain_b"], F.lit(_WORD)).alias("chain_b"))

    def line(h: Column, x: Column) -> Column:
        bytes_ = F.reverse(F.filter(F.split(x, ""), lambda t: t != ""))
        chain = F.aggregate(bytes_, start, step, lambda s: F.struct(s["chain_a"].alias("a"), s["chain_b"].alias("b")))
        return F.aggregate(F.array(chain), h, lambda g, m: F.pmod(_times(g, m["a"]) + m["b"], F.lit(_WORD)))

    return F.aggregate(F.slice(F.split(bytes_view(c), "\n"), first, last - first + 1), F.lit(5381).cast("long"), line)


def in_range(line: Column, first: Column, last: Column) -> Column:
    """Whether a line lies in a range of lines, both ends included."""
    return (line >= first) & (line <= last)


def count_matches(content: Column, needle: Column) -> Column:
    """How often the needle stands in the text, not overlapping, after both have LF newlines and no trailing blanks; 0 for an empty one."""
    n, text = trim_trailing_whitespace(normalize_newlines(needle)), trim_trailing_whitespace(normalize_newlines(content))
    gone = F.length(text) - F.length(F.replace(text, n, F.lit("")))
    return F.when(F.length(n) == 0, 0).otherwise((gone / F.greatest(F.length(n), F.lit(1))).cast("int"))


def match_range(content: Column, needle: Column) -> Column:
    """Struct of the first and last line of the first match; null if there is none."""
    n, text = trim_trailing_whitespace(normalize_newlines(needle)), trim_trailing_whitespace(normalize_newlines(content))
    at = F.instr(text, n)
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    first = newlines(F.substr(text, F.lit(1), at - 1)) + 1
    return F.when((at > 0) & (F.length(n) > 0), F.struct(first.alias("first_line"), (first + newlines(n)).alias("last_line")))


def _indent_unit(c: Column) -> Column:
    lead = F.regexp_extract(c, r"\A(?:[ \t\r\n]*\n)?([ \t]*)[^ \t\r\n]", 1)
    return F.when(F.length(lead) == 0, "  ").when(lead.startswith("\t"), "\t").otherwise(lead)


def correct_indentation(content: Column, needle: Column) -> Column:
    """The needle with each line's indent replaced by one unit of the text's; '' if it occurs as it is, or the units agree."""
    unit = _indent_unit(content)
    bare = F.regexp_replace(needle, r"(\A|\n)[ \t]+\z", "$1")
    fixed = F.array_join(F.transform(F.split(bare, "\n"), lambda x: F.concat(unit, F.regexp_replace(x, r"\A[ \t]*", ""))), "\n")
    return F.when((F.instr(content, needle) > 0) | (unit == _indent_unit(needle)), "").otherwise(fixed)


def char_diff(before: Column, after: Column) -> Column:
    """Changed characters: the longer length without the common start, and without a common end counted up to half of what is left of the shorter."""
    shorter, longer = F.least(F.length(before), F.length(after)), F.greatest(F.length(before), F.length(after))

    def common(a: Column, b: Column) -> Column:
        places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1)))
        return F.coalesce(F.get(first, F.lit(0)) - 1, shorter)

    head = common(before, after)
    tail = F.least(common(F.reverse(before), F.reverse(after)), F.ceil((shorter - head) / 2))
    return (longer - head - tail).cast("int")


def change_summary(before: Column, after: Column) -> Column:
    """What a fix did, for a report: the lines it added or took away, and both lengths in UTF-16 units, which the report calls bytes."""
    lines = F.size(F.split(after, "\n")) - F.size(F.split(before, "\n"))
    units = lambda c: (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")
    sign = F.when(lines > 0, "+").when(lines == 0, "±").otherwise("")
    return F.concat(sign, lines, F.lit(" lines ("), units(before), F.lit(" → "), units(after), F.lit(" bytes)"))
