"""Secret scans: known shapes by pattern, unknown ones by a battery of randomness tests. Columns only, no Python.

A candidate is a long token with a digit in it. Its encoding is inferred from its characters, and three tests ask
whether it could be uniform noise in that encoding: chi-squared for uniform use of the alphabet, Wald-Wolfowitz
runs about the alphabet's middle, and serial correlation of neighbours. Two more figures say how unlikely the token is
if it is no secret: the chance that a source which coincides twice as often as a uniform one would look so even, and
the chance that characters which change between digits, small and capital letters three times in ten would change so
often (a second runs test). Twice the lesser is the p-value of "no secret". These p-values go through a Benjamini-Hochberg step over the whole table with weights in proportion to length, so short tokens, on
which the tests have little power, need more evidence. What passes and doesn't fail the battery is a secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import evaluated, materialise

#: The patterns of the three base kinds, in their listed order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
#: A candidate of the battery: a whole run of these characters with a digit among them.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
#: False-discovery rate; level of the battery; what "no secret" coincides above a uniform source, as a multiple.
FDR, LEVEL, EXCESS = 0.05, 0.01, 1.0
#: How often neighbours that are letters or digits are of different classes in what is no secret.
CHANGES = 0.3
#: Levels of the false-discovery bar.
BARS = 400
KINDS = ("assign", "access", "hex", "random")

_NONE = "cast(array() as array<struct<start:int,rank:int,stop:int,body:string>>)"


def _normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, by a polynomial good to 7.5e-8."""
    # The published coefficients of this approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def _spans(text: Column, pattern: str, rank: int, value_group: int | None = None) -> Column:
    """Places of the leftmost non-overlapping matches, from the pieces between them. Offsets are code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(F.transform(before, F.length).alias("gap"), found.alias("body"), value.alias("value"))
    start = F.expr(f"named_struct('at', 0, 'out', {_NONE})")

    def add(acc, x):
        begin = (acc["at"] + x["gap"]).cast("int")
        stop = (begin + F.length(x["body"])).cast("int")
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), x["value"].alias("body")))
        return F.struct(stop.alias("at"), F.concat(acc["out"], one).alias("out"))

    spans = F.aggregate(steps, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(_NONE))


def _alphabet_size(token: Column) -> Column:
    """Characters of the inferred encoding; null for plain numbers, which are no secrets by themselves."""
    return (
        F.when(token.rlike("^[0-9]+$"), F.lit(None))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0)
        .when(token.rlike("^[A-Z2-7]+$"), 32.0)
        .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36.0)
        .when(token.rlike("^[0-9A-Za-z]+$"), 62.0)
        .otherwise(64.0)
    )


def _tests(span: Column) -> Column:
    """Length, alphabet, squared counts and codes of a candidate."""
    token = span["body"]
    n = F.length(token).cast("double")
    k = _alphabet_size(token)
    chars = F.split(token, "")
    chars = F.filter(chars, lambda c: c != "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    codes = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c).cast("double"))
    return F.struct(n.alias("n"), k.alias("k"), squares.alias("squares"), codes.alias("codes"),
                   span["start"].alias("start"), span["rank"].alias("rank"), span["stop"].alias("stop"))


def _moments(x: Column) -> Column:
    total = F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c)
    ordered = F.array_sort(x["codes"])
    middle = F.get(ordered, (x["n"] / 2).cast("int"))
    return F.struct(x["n"].alias("n"), x["k"].alias("k"), x["squares"].alias("squares"), x["codes"].alias("codes"), (total / x["n"]).alias("mean"),
                    middle.alias("middle"), x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"))


def _sums(x: Column) -> Column:
    pairs = F.zip_with(F.slice(x["codes"], F.lit(1), F.size(x["codes"]) - 1), F.slice(x["codes"], F.lit(2), F.size(x["codes"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.aggregate(x["codes"], F.lit(0.0), lambda acc, c: acc + F.when(c >= x["middle"], 1.0).otherwise(0.0))
    runs = F.aggregate(pairs, F.lit(1.0), lambda acc, p: acc + F.when((p["a"] >= x["middle"]) != (p["b"] >= x["middle"]), 1.0).otherwise(0.0))
    spread = F.aggregate(x["codes"], F.lit(0.0), lambda acc, c: acc + (c - x["mean"]) * (c - x["mean"]))
    lagged = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - x["mean"]) * (p["b"] - x["mean"]))
    kind = lambda c: F.when(c <= 10, 0).when(c <= 36, 1).otherwise(2)
    plain = F.filter(pairs, lambda p: (p["a"] <= 62) & (p["b"] <= 62))
    changes = F.size(F.filter(plain, lambda p: kind(p["a"]) != kind(p["b"]))).cast("double")
    return F.struct(x["n"].alias("n"), x["k"].alias("k"), F.size(plain).cast("double").alias("plain"), changes.alias("changes"), (x["k"] / x["n"] * x["squares"] - x["n"]).alias("chi"), high.alias("high"), runs.alias("runs"),
                    spread.alias("spread"), lagged.alias("lagged"), x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"))


def _p_values(x: Column) -> Column:
    """Two p-values: of uniform noise (the battery's least, times three) and of no secret."""
    n, df = x["n"], x["k"] - 1
    shift = n * EXCESS
    p_text = _normal_cdf((x["chi"] - df - shift) / F.sqrt(2 * (df + 2 * shift)))
    spread = F.sqrt(F.greatest(x["plain"], F.lit(1.0)) * CHANGES * (1 - CHANGES))
    p_change = 1 - _normal_cdf((x["changes"] - 0.5 - x["plain"] * CHANGES) / spread)
    p_none = F.least(F.lit(1.0), 2 * F.least(p_text, p_change))
    cube = F.pow(F.greatest(x["chi"], F.lit(0.0)) / df, F.lit(1 / 3))
    p_chi = 1 - _normal_cdf((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    expected = 2 * x["high"] * (n - x["high"]) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    p_runs = F.when(variance > 0, 2 * _normal_cdf(-F.abs((x["runs"] - expected) / F.sqrt(F.when(variance > 0, variance).otherwise(1.0))))).otherwise(0.0)
    r1 = F.when(x["spread"] > 0, x["lagged"] / F.when(x["spread"] > 0, x["spread"]).otherwise(1.0)).otherwise(1.0)
    p_serial = 2 * _normal_cdf(-F.abs((r1 + 1 / n) * F.sqrt(n)))
    return F.struct(n.alias("n"), p_none.alias("p"), (3 * F.least(p_chi, p_runs, p_serial)).alias("noise"), x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop"))


def _joined(spans: Column) -> Column:
    kind = lambda x: F.get(F.array(*(F.lit(k) for k in KINDS)), x["rank"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _found(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts, base spans and candidates (n, p, noise, start, rank, stop)."""
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    spans = evaluated(
        src, ["doc_id"],
        assign=F.filter(_spans(text, ASSIGN, 0, 2), lambda x: F.length(x["body"]) >= MIN_VALUE),
        access=_spans(text, ACCESS, 1),
        hex=_spans(text, HEX, 2),
        tokens=_spans(text, TOKEN, 3),
    )
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"], x["rank"], x["stop"]))
    tested = F.filter(F.transform("tokens", _tests), lambda x: x["k"].isNotNull())
    for step in (_moments, _sums, _p_values):
        tested = F.transform(tested, step)
    base = F.array_sort(F.concat(*(bare(F.col(c)) for c in ("assign", "access", "hex"))))
    counts = {f"n_{c}": F.size(c).cast("bigint") for c in ("assign", "access", "hex")}
    return evaluated(spans, ["doc_id"], **counts, base=base, tested=tested)


def battery(docs: DataFrame) -> DataFrame:
    """A row for each candidate: doc_id, start, stop, n, p (of no secret) and noise (the battery's, of uniform noise)."""
    one = _found(docs).select("doc_id", F.explode("tested").alias("x"))
    return one.select("doc_id", "x.start", "x.stop", "x.n", "x.p", "x.noise")


def discovery_bar(found: DataFrame, rate: float = FDR) -> tuple[float, float]:
    """The mean length of all candidates, and the Benjamini-Hochberg bar for their weighted p-values.

    Weights are lengths over their mean, so they are one on average. The bar is the highest of ``BARS`` fixed levels (an
    eighth of a power of two apart) at which the rate holds, so one aggregate of as many rows says it: over the whole
    table, the expected share of tokens that are no secret among those that pass is at most ``rate``. No candidate:
    (1, 0).
    """
    each = found.select(F.explode("tested").alias("x")).select("x.n", "x.p")
    m, mean = each.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    q = F.greatest(F.col("p") * mean / F.col("n"), F.lit(1e-300))
    level = F.least(F.greatest(F.floor(-8 * F.log2(q)), F.lit(-1)), F.lit(BARS)).alias("level")
    counts = dict(map(tuple, each.select(level).groupBy("level").agg(F.count("*")).collect()))  # at most BARS + 2 rows
    passing, bar = 0, 0.0
    for k in range(BARS, -1, -1):
        passing += counts.get(k, 0)
        if passing and m * 2 ** (-k / 8) <= rate * passing:
            bar = 2 ** (-k / 8)
    return mean, bar


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each text.

    Takes ``doc_id`` (any type) and ``text``; other columns are not read. Returns per row: ``doc_id``, ``n_assign``,
    ``n_access``, ``n_hex``, ``base_sha256`` (of the base spans, ``kind:start:end`` in order, comma-joined), ``spans``
    (these and the battery's, kind ``random``, joined likewise) and ``n_random``. Offsets are code points, ends are
    exclusive. A span of the battery that overlaps a base span is left out. Null and empty texts have no spans
    (counts of 0, the digest of no text); null ids and repeated rows stay as they are. No shuffle of texts: spans and
    candidates are written down, an aggregate says the bar (see :func:`discovery_bar`), and a second pass applies it.
    """
    found = materialise(_found(docs))
    mean, bar = discovery_bar(found)
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    # The same levels as in the aggregate: a token passes if its p-value is at most the bar.
    passes = lambda x: (x["p"] * mean / x["n"] <= F.lit(bar)) & (x["noise"] >= LEVEL)
    random = F.transform(F.filter("tested", lambda x: passes(x) & clear(x)), lambda x: F.struct(x["start"], x["rank"], x["stop"]))
    found = evaluated(found, ["doc_id", "n_assign", "n_access", "n_hex", "base"], random=random)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("bigint").alias("n_random"),
    )
