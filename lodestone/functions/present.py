"""Presentation of hits: snippets, highlights, responses, lines for a terminal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import PY_LOWER, PY_TOKEN, TOKEN_CLASS, ascii_lower, tokens

# fixed values: the modes by number
MODES = ("conjunctive", "disjunctive", "semantic", "reranking")
REQUEST = "query string, query_type int, n_results int, snippet_len int"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def snippet(text: Column, terms: Column, length: int = 200) -> Column:
    """About ``length`` bytes of ``text`` round the first occurrence of the first of the sorted ``terms`` that it holds;
    both ends move outward to whole characters. Null where no term occurs, or where text or terms are null."""
    if length < 1:
        raise ValueError("the snippet length must be positive")
    half = length // 2

    def find(anchor: Column) -> Column:
        around = F.concat(F.lit(f"(?<!{TOKEN_CLASS})"), anchor, F.lit(f"(?!{TOKEN_CLASS})"))
        pos = F.octet_length(F.get(F.split(ascii_lower(text), around, 2), F.lit(0)))
        return let(F.struct(pos.alias("pos"), F.octet_length(text).alias("size"), F.decode(F.encode(text, "UTF-8"), "ISO-8859-1").alias("data")), ends)  # one character for each byte

    def ends(x: Column) -> Column:
        first, last = F.greatest(x["pos"] - half, F.lit(0)), F.least(x["pos"] + half, x["size"])
        inside = (first < x["size"]) & (F.ascii(F.substring(x["data"], first + 1, F.lit(1))) >= 128)
        # the runs beyond the ASCII range that hold the two ends
        back = F.when(inside, F.length(F.regexp_extract(F.substring(x["data"], F.lit(1), first + 1), r"([\x80-\xFF]+)$", 1))).otherwise(0)
        run = F.length(F.regexp_extract(F.substring(x["data"], last + 1, x["size"]), r"^([\x80-\xFF]*)", 1))
        bounds = F.struct(F.greatest(first - back, F.lit(0)).alias("begin"), (last + run).alias("end"), run.alias("run"), x["size"].alias("size"), x["data"].alias("data"))
        return let(bounds, lambda y: F.decode(F.encode(F.substring(y["data"], y["begin"] + 1, y["end"] + F.when((y["run"] > 0) & (y["end"] + 1 < y["size"]), 1).otherwise(0) - y["begin"]), "ISO-8859-1"), "UTF-8"))

    anchor = let(tokens(text), lambda words: F.get(F.filter(terms, lambda t: F.array_contains(words, t)), F.lit(0)))
    return let(anchor, lambda a: F.when(a.isNotNull(), find(a)))


def windows(text: str, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], str]:
    """``snippet`` in Python, for several (term, length) of one text that is read once; terms that it lacks are left out."""
    data, low = text.encode(), text.translate(PY_LOWER)
    missing, begins = {t for t, _ in wanted}, {}
    at = done = 0
    for m in PY_TOKEN.finditer(low):
        if m[0] in missing:
            at += len(low[done : m.start()].encode())
            done = m.start()
            begins[m[0]] = at
            missing.discard(m[0])
            if not missing:
                break
    out = {}
    for term, length in wanted:
        if term in begins:
            out[term, length] = _window(data, begins[term] - length // 2, begins[term] + length // 2)
    return out


def _window(data: bytes, first: int, last: int) -> str:
    first, last = max(first, 0), min(last, len(data))
    before, run = data[: first + 1], data[last:]
    # beyond the ASCII range both ends give way to the whole run of such bytes, and one byte more
    if first < len(data) and before.strip(_BEYOND) != before.lstrip(_BEYOND):
        first = max(len(before.rstrip(_BEYOND)) - 1, 0)
    elif first < len(data) and not before.strip(_BEYOND):
        first = 0
    moved = len(run) - len(run.lstrip(_BEYOND))
    last += moved + (moved > 0 and last + moved + 1 < len(data))
    return data[first:last].decode("utf-8", "replace")


_BEYOND = bytes(range(128, 256))


def highlight(text: Column, words: list[str] | Column) -> Column:
    """``<b>`` round every run of letters that equals one of ``words``, in any case; figures are never marked. ``words`` may be
    a column of arrays, other words for each row. Words without letters are ignored; null text gives null."""
    if isinstance(words, list):
        words = F.array(*map(F.lit, words)).cast("array<string>")
    letters = F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})("), F.array_join(letters, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.coalesce(F.size(letters), F.lit(0)) > 0, F.regexp_replace(text, pattern, F.lit("<b>$1</b>"))).otherwise(text)


def elapsed(micros: Column) -> Column:
    """Microseconds below 1000, else milliseconds with two decimals."""
    return F.when(micros < 1000, F.format_string("%.2f us", micros.cast("double"))).otherwise(F.format_string("%.2f ms", micros / 1000))


def mode_of(prefix: Column) -> Column:
    """The first mode whose name begins with ``prefix`` (the empty one gives the first); null where none does."""
    return F.coalesce(*(F.when(F.startswith(F.lit(m), prefix), m) for m in MODES))


def request_error(request: Column) -> Column:
    """Null for a sound request (a struct of REQUEST), else what is wrong with it."""
    return (
        F.when(request.isNull() | request["query"].isNull() | request["query_type"].isNull() | request["n_results"].isNull() | request["snippet_len"].isNull(), "missing or mistyped field")
        .when(request["n_results"] < 1, "n_results must be positive")
        .when(request["snippet_len"] < 1, "snippet_len must be positive")
    )


def parse_request(json: Column) -> Column:
    return F.from_json(json, REQUEST)


def cli_line(rank: Column, score: Column, freqs: Column, url: Column, text: Column) -> Column:
    """One hit for a terminal; ``freqs`` is an array of (term, freq), null where the mode has none."""
    terms = F.concat_ws("", F.transform(freqs, lambda x: F.concat(x["term"], F.lit("("), x["freq"].cast("string"), F.lit(") "))))
    return F.concat(F.format_string("%d. [%.2f] ", rank.cast("int"), score), terms, F.lit("\n"), F.coalesce(url, F.lit("")), F.lit("\n..."), F.coalesce(text, F.lit("")), F.lit("..."))
