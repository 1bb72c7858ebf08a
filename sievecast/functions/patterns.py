"""Pattern scanners: one text -> an array of hits (line, col, pattern, snippet), lines and byte columns from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catches import empty_catches
from .mask import mask, mask_keeping_quotes
from .text import bytes_view, clip_bytes

#: Words whose assigned literal is a secret, in any case.
SECRET_WORDS = ("api_key", "apikey", "secret", "password", "passwd", "auth_token", "access_token", "private_key")
_SPACE = r"[ \t\n\x0B\f\r]*"
_first = lambda words: "(?=[" + "".join(sorted({w[0] for w in words})) + "])"  # noqa: E731  a look at one character spares most places all else
_BEGINS, _ENDS = r"(?<![A-Za-z0-9_$])", r"(?![A-Za-z0-9_$])"
#: Over the plain mask. No two of them match at one place, so one search can look for several.
PLAIN = {
    "eval": r"(?<!\.)eval" + _ENDS + _SPACE + r"\(",
    "debugger": r"debugger" + _ENDS,
    "console-log": r"console\.(?:log|warn|error|info|debug)" + _ENDS + _SPACE + r"\(",
    "alert": r"(?<!\.)alert" + _ENDS + _SPACE + r"\(",
}
#: Over the lower-cased mask that keeps quotes: at least eight characters in the literal, or up to the end of the text.
SECRET = _first(SECRET_WORDS) + r"(?<![a-z_])(?:" + "|".join(SECRET_WORDS) + ")" + _SPACE + "[=:]" + _SPACE + r"(['\"`])[\x02\n]{8,}(?:\1|\z)"
#: A text without one of these can't hold the pattern; looking for them is cheaper than its regex.
_ANCHORS = {"eval": ("eval",), "debugger": ("debugger",), "console-log": ("console.",), "alert": ("alert",), "empty-catch": ("catch",), "hardcoded-secret": ("api", "secret", "passw", "token", "private_key")}
PATTERNS = (*PLAIN, "hardcoded-secret", "empty-catch")
_HITS = "array<struct<line:int,col:int,pattern:string,snippet:string>>"


def _measured(x: Column) -> Column:
    """Of a piece of text: its length, its newlines, and the length of what stands behind the last."""
    return F.struct(F.length(x).alias("n"), (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).alias("newlines"), F.length(F.substring_index(x, "\n", -1)).alias("tail"))


def places(searched: Column, regex: str) -> Column:
    """Hits of a regex as structs (at, line, col, matched): offset from 0, line and column from 1.

    The text is cut at the hits; each piece is measured once, and one fold over those numbers carries
    offset, line and column from piece to piece.
    """
    measured = F.transform(F.split(searched, regex, -1), _measured)
    found = F.transform(F.regexp_extract_all(searched, F.lit(regex), F.lit(0)), lambda h: F.struct(h.alias("text"), _measured(h).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(0).alias("col"), F.array().cast("array<struct<at:int,line:int,col:int,matched:string>>").alias("out"))

    def behind(s: Column, m: Column) -> Column:
        return F.struct((s["at"] + m["n"]).alias("at"), (s["line"] + m["newlines"]).alias("line"), F.when(m["newlines"] > 0, m["tail"]).otherwise(s["col"] + m["n"]).alias("col"), s["out"].alias("out"))

    def step(s: Column, x: Column) -> Column:
        at, line, col = s["at"] + x["p"]["n"], s["line"] + x["p"]["newlines"], F.when(x["p"]["newlines"] > 0, x["p"]["tail"]).otherwise(s["col"] + x["p"]["n"])
        hit = F.struct(at.alias("at"), line.alias("line"), (col + 1).alias("col"), x["h"]["text"].alias("matched"))
        here = F.struct(at.alias("at"), line.alias("line"), col.alias("col"), F.concat(s["out"], F.array(hit)).alias("out"))
        return F.when(x["h"].isNull(), s).otherwise(behind(here, x["h"]["m"]))

    zipped = F.zip_with(measured, found, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    return F.aggregate(zipped, start, step, lambda s: s["out"])


def snippet(source: Column, at: Column) -> Column:
    """What stands at an offset of a byte view, clipped, as text again."""
    return F.decode(F.encode(clip_bytes(F.substr(source, at + 1, F.lit(80))), "ISO-8859-1"), "UTF-8")


def hits(searched: Column, source: Column, regex: str, pattern: Column | str, whole: bool = False) -> Column:
    """Hits of a regex in ``searched``, which is ``source`` character by character. Both are byte views, and columns of their own.

    ``pattern`` is a name, or a function of what matched that gives it. With ``whole``, a hit has all that the regex matched too.
    """
    name = pattern if callable(pattern) else lambda matched: F.lit(pattern)
    text = lambda h: [F.decode(F.encode(h["matched"], "ISO-8859-1"), "UTF-8").alias("matched")] if whole else []
    return F.transform(places(searched, regex), lambda h: F.struct(h["line"].alias("line"), h["col"].alias("col"), name(h["matched"]).alias("pattern"), snippet(source, h["at"]).alias("snippet"), *text(h)))


def detect(plain: Column, quoted: Column, text: Column, only: str | None = None) -> Column:
    """All hits of a text, or those of one pattern, sorted by line and column. Takes the columns of :func:`views`.

    The four plain patterns are one search; a text without any of their words is not searched.
    """
    wanted = PATTERNS if only is None else (only,)
    has = lambda where, *names: reduce(Column.__or__, [F.contains(where, F.lit(x)) for name in names for x in _ANCHORS[name]])
    none = F.array().cast(_HITS)
    out, own = [], [p for p in PLAIN if p in wanted]
    if own:
        named = lambda h: reduce(lambda c, p: c.when(h.startswith(p.split("-")[0]), p), own[1:], F.when(h.startswith(own[0].split("-")[0]), own[0]))
        out.append(F.when(has(plain, *own), hits(plain, text, _first(own) + _BEGINS + "(?:" + "|".join(PLAIN[p] for p in own) + ")", named)).otherwise(none))
    if "hardcoded-secret" in wanted:
        out.append(F.when(has(F.lower(quoted), "hardcoded-secret"), hits(F.lower(quoted), text, SECRET, "hardcoded-secret")).otherwise(none))
    if "empty-catch" in wanted:
        found = empty_catches(F.when(has(plain, "empty-catch"), plain))
        out.append(F.transform(found, lambda h: F.struct(h["line"].alias("line"), h["col"].alias("col"), F.lit("empty-catch").alias("pattern"), snippet(text, h["at"]).alias("snippet"))))
    return F.array_sort(reduce(F.concat, out))


def views(files: DataFrame) -> DataFrame:
    """``files`` with the byte view of their content and its two masks, each computed once: _text, _plain, _quoted."""
    out = files.withColumn("_text", bytes_view(F.col("content")))
    return out.withColumns({"_plain": mask(F.col("_text")), "_quoted": mask_keeping_quotes(F.col("_text"))})
