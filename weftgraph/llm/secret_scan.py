"""Secret scans: base patterns plus sliding-window entropy over candidate strings, in DataFrame functions only.

Base kinds (assign, access, hex) are leftmost non-overlapping matches. The method adds kinds ``entropy_hex`` and
``entropy_base64``: a candidate is a run of 20 or more characters of the class with a letter and a digit; the counts of
a sliding window are updated by one character in and one out, its Shannon entropy follows from the running sum of
n log2 n, and a candidate is a secret if the largest entropy reaches the class's threshold. Candidates that match the
allow list, or lie inside a base span or a span of an earlier class, are suppressed.

Positions are code points, ends exclusive. Defined results: null counts as empty and has no spans; repeated rows are
scanned one by one; whole texts are scanned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Base64 characters; '-' and '_' count as '+' and '/'.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
#: (kind, run of the class, least entropy of a window)
CLASSES = [("entropy_hex", r"[0-9A-Fa-f]{20,}", 3.0), ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 3.9)]
#: Candidates that are never secrets: UUIDs, integrity digests, alphabets in order, fillers, dates and plain paths of words.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:sha256|sha384|sha512)-",
    r"(?i)abcdefghij|0123456789abcdef|1234567890",
    r"(?i)example|placeholder|changeme|xxxxxx|000000",
    r"^(?:/?[a-z]+|/?[0-9]{1,4})(?:[/_-](?:[a-z]+|[0-9]{1,4}))+/?$",
]


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(_either(w) for w in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", *(k for k, _, _ in CLASSES)]


#: Items whose running values are gathered in one array before the next array begins.
CHUNK = 256
SPAN = "struct<start:int,kind:int,end:int,found:string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(items: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Array of (item, before): ``before`` is the fold of ``step`` over the items that come earlier.

    Growing arrays are copied at each step, so items go in chunks: n items cost n x CHUNK + (n / CHUNK)^2 copies of a reference."""
    many = f"array<struct<item:{kind},before:int>>"

    def grow(acc: Column, x: Column) -> Column:
        now = F.struct(x.alias("item"), acc.at.alias("before"))
        return F.struct(step(acc.at, x).alias("at"), F.concat(acc.out, F.array(now)).alias("out"))

    def chunk(c: Column, first: Column) -> Column:
        return F.aggregate(c, F.struct(first.alias("at"), F.array().cast(many).alias("out")), grow, lambda acc: acc.out)

    def pass_on(acc: Column, c: Column) -> Column:
        return F.struct(F.aggregate(c, acc.at, step).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(xs, i, CHUNK))

    def chained(chunks: Column) -> Column:
        firsts = F.aggregate(chunks, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), pass_on, lambda acc: acc.out)
        return F.flatten(F.zip_with(chunks, firsts, chunk))

    return _let(_let(items, cut), chained)


def _matches(text: Column, pattern: str, kind: int, sure: Column | None = None) -> Column:
    """Array of (start, kind, end, found) of all matches; ``sure`` is a cheap test that texts with a match pass."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))
    placed = _before(pairs, "struct<gap:string,found:string>", F.lit(0), lambda at, p: at + F.length(p.gap) + F.length(p.found))

    def span(x: Column) -> Column:
        start = x.before + F.length(x.item.gap)
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x.item.found)).alias("end"), x.item.found.alias("found"))

    spans = F.transform(placed, span)
    return spans if sure is None else F.when(sure, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy of ``window`` (at most 70) characters in a row, by incremental counts.

    The counts of the alphabet are one string, a character for each count; a step overwrites the count of the character
    that comes in and that of the one that goes out, and moves the sum of n log2 n by those two.
    """
    text = F.translate(run, "-_", "+/")
    zero = ord("0")

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def place(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(text, at, F.lit(1)))

    def count(counts: Column, at: Column) -> Column:
        return F.ascii(F.substring(counts, at, F.lit(1))) - F.lit(zero)

    def put(counts: Column, at: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + F.lit(zero)), at)

    def step(acc: Column, i: Column) -> Column:
        moved = F.struct(place(i).alias("come"), F.when(i > window, place(i - window)).otherwise(F.lit(0)).alias("go"))

        def look(m: Column) -> Column:
            n_out = F.when(m.go > 0, count(acc.counts, m.go)).otherwise(F.lit(0))
            return F.struct(m.come.alias("come"), m.go.alias("go"), count(acc.counts, m.come).alias("n_in"), n_out.alias("n_out"))

        def update(m: Column) -> Column:
            n_in, n_out = m.n_in, m.n_out
            added = put(acc.counts, m.come, n_in + 1)
            one_in, one_out = weight(n_in + 1) - weight(n_in), weight(n_out - 1) - weight(n_out)
            same, first = m.come == m.go, m.go == 0
            counts = F.when(same, acc.counts).when(first, added).otherwise(put(added, m.go, n_out - 1))
            total = acc.total + F.when(same, F.lit(0.0)).when(first, one_in).otherwise(one_in + one_out)
            entropy = F.when(i >= window, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(acc.best, entropy).alias("best"))

        return F.element_at(F.transform(F.transform(F.array(moved), look), update), 1)

    start = F.struct(F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, lambda acc: acc.best)


def _secrets(candidates: Column, found: Column, least: float, allowed: str) -> Column:
    """The candidates with letters and digits that are not allowed, lie in none of the spans ``found``, and have entropy enough.

    A span that holds a candidate begins no later and ends no earlier, so in the order of starts the largest end so far tells."""
    event = "struct<start:int,mine:int,end:int,kind:int,found:string>"

    def events(spans: Column, mine: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(mine).alias("mine"), s.end.alias("end"), s.kind.alias("kind"), s.found.alias("found")))

    def test(x: Column) -> Column:
        s = x.item
        mixed = F.rlike(s.found, F.lit("[0-9]")) & F.rlike(s.found, F.lit("[A-Za-z]"))
        fine = ~F.rlike(s.found, F.lit(allowed)) if allowed else F.lit(True)
        return F.when((s.mine == 1) & (x.before < s.end) & mixed & fine, window_entropy(s.found) >= least).otherwise(F.lit(False))

    in_order = F.sort_array(F.concat(events(found, 0), events(candidates, 1)))
    reached = _before(in_order, event, F.lit(-1), lambda at, e: F.when(e.mine == 0, F.greatest(at, e.end)).otherwise(at))
    kept = F.transform(F.filter(reached, test), lambda x: F.struct(x.item.start.alias("start"), x.item.kind.alias("kind"), x.item.end.alias("end"), x.item.found.alias("found")))
    return F.when(F.size(candidates) > 0, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan_secrets(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, allow: list[str] | None = None) -> DataFrame:
    """One row per document: row, spans (array of (start, kind, end); kind is a place in KINDS), by start, then kind."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), text.alias("text"))
    t, low = F.col("text"), F.lower("text")
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    assign = F.filter(_matches(t, ASSIGN, 0, named), lambda s: F.length(F.regexp_extract(s.found, ASSIGN, 2)) >= 6)
    access = F.filter(_matches(t, ACCESS, 1, F.contains(t, F.lit("AKIA"))), lambda s: s.end - s.start >= 20)
    hexes = _matches(t, HEX, 2, F.rlike(t, F.lit(HEX)))
    base = base.withColumn("found", F.concat(assign, access, hexes))
    allowed = "|".join(f"(?:{p})" for p in (ALLOW if allow is None else allow))

    def more(least: float) -> Callable[[Column], Column]:
        return lambda c: F.concat("found", _secrets(c, F.col("found"), least, allowed))

    for k, (_, run, least) in enumerate(CLASSES):
        candidates = _matches(t, run, len(KINDS) - len(CLASSES) + k, F.rlike(t, F.lit(run)))
        base = base.withColumn("found", _let(candidates, more(least)))
    spans = F.sort_array(F.transform("found", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))))
    return base.select("row", spans.alias("spans"))


def span_text(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
