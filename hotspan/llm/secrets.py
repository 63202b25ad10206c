"""Secret scans: fixed patterns plus character Markov models of random strings and ordinary identifiers.

Everything is a DataFrame expression: patterns are split and extracted with the built-in regular expressions, and the
models are one table of log-likelihood ratios per pair of characters, trained by a grouped count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, what each looks for, and how long (group, characters) a match must be.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

# Characters a random string may have; the model's states are these and nothing else.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
MIN_LENGTH = 20
# Mean log-likelihood ratio per pair of characters above which a stretch counts as random, the excess over it that a
# stretch needs in sum, and the loss after its best place that ends a stretch.
THRESHOLD, EXCESS, DROP = 0.1, 8.0, 4.0
# Share of the pair counts in a model; the rest is spread evenly over the pairs of the same classes of characters.
PAIRS = 0.5
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+", "/", "_", "=", "-")
# Code points of the blocks a text is cut into, so that taking a piece of it doesn't run through all before it.
BLOCK = 1024
# Bound on the documents whose words train the model of ordinary identifiers, and on the random strings made.
SAMPLE_DOCUMENTS = 2000
SAMPLE_STRINGS = 6000


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda a repeated expression is worked out every time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: Column, kind: str, step) -> Column:
    """What ``step`` makes of all earlier values, for each value."""
    begin = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(values, begin, lambda acc, v: F.struct(
        step(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def before_each(values: Column, total, step) -> Column:
    """``step`` over all earlier values (bigint, from 0), for each value of an array, in chunks of about the root of its length.

    Appending copies an array, so one pass over all values would take time with their square. ``total`` sums a chunk up.
    """
    zero = F.lit(0).cast("bigint")

    def chunked(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        cut = let(width, lambda w: F.transform(F.sequence(F.lit(1), F.size(v), w), lambda i: F.slice(v, i, w)))
        return let(cut, lambda chunks: F.flatten(F.zip_with(
            chunks, _running(F.transform(chunks, total), zero, "bigint", step), lambda c, at: _running(c, at, "bigint", step))))

    return let(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(F.array().cast("array<bigint>")))


def sums_before(values: Column) -> Column:
    """Sum of all earlier values, for each value."""
    def add(a: Column, b: Column) -> Column:
        return a + b
    return before_each(values, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), add), add)


def greatest_before(values: Column) -> Column:
    """The greatest of all earlier values, at least 0, for each value."""
    return before_each(values, F.array_max, lambda a, b: F.greatest(a, b))


def _at(text: Column, pattern: str) -> Column:
    """Non-overlapping matches from the left as an array of (start, found), in code points, counted from 0."""
    def placed(pairs: Column) -> Column:
        before = sums_before(F.transform(pairs, lambda p: p["gap"] + F.length(p["found"])))
        return F.zip_with(pairs, before, lambda p, at: F.struct((at + p["gap"]).alias("start"), p["found"].alias("found")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(found, lambda f: F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f)), f,
        lambda p, m: F.struct(F.length(p).cast("bigint").alias("gap"), m.alias("found"))))
    none = F.array().cast("array<struct<start:bigint,found:string>>")
    return F.when(F.regexp(text, F.lit(pattern)), let(pairs, placed)).otherwise(none)


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with the spans (start, end), sorted by start, replaced; ``mark`` of (covered before, start, end) is put for each."""
    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substring(some, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))

    def cut(blocks: Column) -> Column:
        def whole(s: Column) -> Column:
            covered = greatest_before(F.transform(s, lambda x: x["end"]))
            parts = F.zip_with(s, covered, lambda x, at: F.concat(
                F.when(x["start"] > at, piece(blocks, at, x["start"])).otherwise(""), mark(at, x["start"], x["end"])))
            rest = piece(blocks, F.array_max(F.transform(s, lambda x: x["end"])), F.length(text).cast("bigint"))
            return F.concat(F.array_join(parts, ""), rest)
        return let(spans, whole)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(blocks, cut)).otherwise(text)


def _spans(found: Column, order: int, cut=None) -> Column:
    """Matches as spans; ``cut`` is where the secret itself begins."""
    def one(m: Column) -> Column:
        end = (m["start"] + F.length(m["found"])).cast("bigint")
        return F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), end.alias("end"),
                        (m["start"] if cut is None else cut(m, end)).cast("bigint").alias("cut"))
    return F.transform(found, one)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: matches whose value is too short are dropped after matching, as they use up text."""
    def value(m: Column) -> Column:
        return F.regexp_extract(m["found"], ASSIGN, 2)
    assign = F.filter(_at(text, ASSIGN), lambda m: F.length(value(m)) >= 8)
    return F.concat(_spans(assign, 0, lambda m, end: end - F.length(value(m))),
                    _spans(_at(text, ACCESS), 1), _spans(_at(text, HEX), 2))


def random_strings(spark, n: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled examples of random strings: hash digests as base 64 in both alphabets, as letters with digits and as
    upper-case letters with digits. Long hexadecimal ones are a fixed pattern, and short ones are in many ordinary names."""
    base64 = F.base64(F.unhex(F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256)))
    upper = F.regexp_replace(F.upper(base64), "[^A-Z0-9]", "")
    mixed = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    kind = F.pmod("id", F.lit(4))
    return spark.range(n).select(
        F.when(kind == 0, F.translate(base64, "+/=", "-_")).when(kind == 1, base64).when(kind == 2, upper).otherwise(mixed).alias("s"))


def ordinary_patterns(spark, n: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled examples of strings without words that aren't secret: rules, repeated letters, alphabets, numbers, dates and UUIDs."""
    digest = F.sha2(F.concat(F.lit("ordinary-"), F.col("id").cast("string")), 256)
    number, turn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)), F.pmod(F.floor(F.col("id") / 6), F.lit(len(ALPHABET))).cast("int")
    letter = F.substring(F.lit(ALPHABET), turn + 1, F.lit(1))
    rule = F.repeat(letter, F.lit(40))
    alphabet = F.get(F.array(*(F.lit(c * 2) for c in CLASSES[:3])), F.pmod(turn, F.lit(3)))
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.pmod(number, F.lit(12_000)).cast("int"))
    dates = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.date_format(day, "yyyyMMdd"))
    uuid = F.concat_ws("-", *(F.substring(digest, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    uuid = F.when(turn % 2 == 0, uuid).otherwise(F.upper(uuid))
    kind = F.pmod("id", F.lit(6))
    return spark.range(n).select(
        F.when(kind == 0, rule).when(kind == 1, alphabet).when(kind == 2, dates).when(kind == 3, uuid).when(
            kind == 4, F.concat(number.cast("string"), F.lit("0"), F.reverse(number.cast("string")))).otherwise(digest).alias("s"))


def ordinary_identifiers(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled examples of ordinary identifiers: words of a bounded sample of documents, alone and joined in pairs
    as snake case, camel case, with hyphens, as paths and with numbers.

    The sample is drawn from different texts, so that copies count once, and takes each text as a whole.
    """
    clean = F.regexp_replace("t", "|".join((ASSIGN, ACCESS, HEX)), " ")
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(text).alias("k"))
    different = hashed.agg(F.approx_count_distinct("k")).first()[0]
    chance = 2.0 * documents / max(1, different)  # thins out ahead of the sort, so that it sees a bounded number of texts
    drawn = hashed.where(F.pmod("k", F.lit(1_000_003)) < F.lit(1_000_003 * chance))
    sample = drawn.groupBy("k").agg(F.min("t").alias("t")).orderBy("k").limit(documents).select(clean.alias("t"), "k")
    words = sample.select("k", F.filter(F.regexp_extract_all("t", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.length(w) < 20).alias("w"))
    pairs = words.select("k", F.posexplode(F.zip_with("w", F.expr("slice(w, 2, greatest(size(w), 1))"), lambda a, b: F.struct(
        a.alias("a"), b.alias("b")))).alias("i", "p")).where("p.b is not null")
    a, b, kind = F.col("p.a"), F.col("p.b"), F.pmod(F.xxhash64("k", "i"), F.lit(8))
    number = F.pmod(F.xxhash64("i", "k"), F.lit(2030)).cast("string")
    return pairs.select(
        F.when(kind == 0, F.concat(a, F.lit("_"), b)).when(kind == 1, F.concat(a, F.initcap(b))).when(
            kind == 2, F.concat(a, F.lit("-"), b)).when(kind == 3, F.concat(a, F.lit("/"), b)).when(
            kind == 4, F.concat(a, F.lit("_"), number)).when(kind == 5, F.concat(F.initcap(a), F.initcap(b))).when(
            kind == 6, F.concat(F.initcap(a), F.substring(number, 1, 2), F.initcap(b), F.substring(number, -1, 1), F.initcap(a))).otherwise(
            F.concat(a, b)).alias("s"))


def train(random: DataFrame, ordinary: DataFrame, column: str = "s") -> list[float]:
    """Log-likelihood ratios of the next character given the last one, for every pair of the alphabet.

    First-order Markov models from grouped counts; the result has one number per pair of characters however many
    samples there are. Each is an even mixture of the pair's own share and the share of its two classes of characters,
    so that a pair no sample has says little. Characters outside the alphabet break a string.
    """
    def counts(samples: DataFrame, name: str) -> DataFrame:
        pair = F.explode(F.transform(F.sequence(F.lit(1), F.length(column) - 1), lambda i: F.substring(F.col(column), i, F.lit(2))))
        return samples.where(F.length(column) > 1).select(pair.alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias(name))

    size, seen = len(ALPHABET), {}
    both = counts(random, "r").join(counts(ordinary, "o"), "pair", "full")
    known = both.where(F.col("pair").rlike(rf"^[{ALPHABET}]{{2}}$"))
    for pair, r, o in known.select("pair", F.coalesce("r", F.lit(0)), F.coalesce("o", F.lit(0))).collect():
        seen[pair] = (r, o)
    of = {c: k for k, members in enumerate(CLASSES) for c in members}

    def model(which: int) -> list[float]:
        by_class = [[1.0 * len(members) for members in CLASSES] for _ in CLASSES]
        for pair, n in seen.items():
            by_class[of[pair[0]]][of[pair[1]]] += n[which]
        out = []
        for a in ALPHABET:
            row = [seen.get(a + b, (0, 0))[which] for b in ALPHABET]
            classes, total = by_class[of[a]], sum(row)
            even = [classes[of[b]] / sum(classes) / len(CLASSES[of[b]]) for b in ALPHABET]
            own = PAIRS if total else 0.0
            out += [own * n / max(1, total) + (1 - own) * e for n, e in zip(row, even)]
        return out

    return [math.log(r / o) for r, o in zip(model(0), model(1))]


def random_stretches(token: Column, model: list[float], min_length: int = MIN_LENGTH, threshold: float = THRESHOLD) -> Column:
    """(start, end) of the stretches of a string over the alphabet that the models call random, in one pass.

    A stretch grows while the sum of its pairs' ratios, each less the threshold, stays near its best; it reaches to the best
    place and needs EXCESS in sum. Then it is widened to the next separator on both sides and must have ``min_length`` characters.
    """
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    none = F.array().cast("array<struct<start:int,end:int>>")

    def state(i: Column, run: Column, top: Column, start: Column, end: Column, out: Column) -> Column:
        return F.struct(i.alias("i"), run.alias("run"), top.alias("top"), start.alias("start"), end.alias("end"), out.alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["top"] >= EXCESS, F.array_append(acc["out"], F.struct(acc["start"].alias("start"), acc["end"].alias("end")))).otherwise(acc["out"])

    def step(acc: Column, v: Column) -> Column:
        def after(run: Column) -> Column:
            start, i = F.when(acc["run"] > 0, acc["start"]).otherwise(acc["i"]), acc["i"] + 1
            ends = (run <= 0) | (run < acc["top"] - DROP)
            best = run >= acc["top"]
            return F.when(ends, state(i, F.lit(0.0), F.lit(0.0), i, i, closed(acc))).otherwise(state(
                i, run, F.greatest(run, acc["top"]), start, F.when(best, i + 1).otherwise(acc["end"]), acc["out"]))
        return let(F.greatest(acc["run"], F.lit(0.0)) + v, after)

    def widened(s: Column) -> Column:
        # a separator within the outer three characters belongs to the stretch before or after
        inside = F.substring(token, s["start"] + 1, s["end"] - s["start"])
        start = s["start"] + F.length(F.regexp_extract(inside, "^[^/=_-]{0,2}[/=_-]", 0))
        end = s["end"] - F.length(F.regexp_extract(inside, "[/_-][^/=_-]{0,2}$", 0))
        left = F.length(F.regexp_extract(F.substring(token, F.lit(1), start), "[^/=_-]*$", 0))
        right = F.length(F.regexp_extract(F.substring(token, end + 1, F.length(token)), "^[^/=_-]*=*", 0))
        return F.struct((start - left).alias("start"), (end + right).alias("end"))

    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    ratios = let(places, lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.get(
        table, a * len(ALPHABET) + b) - threshold))
    begin = state(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), none)
    found = F.array_distinct(F.transform(F.aggregate(ratios, begin, step, closed), widened))
    return F.filter(found, lambda s: s["end"] - s["start"] >= min_length)


def secret_spans(docs: DataFrame, model: list[float], text: str = "text", min_length: int = MIN_LENGTH,
                 threshold: float = THRESHOLD) -> DataFrame:
    """Add ``_base`` and ``_spans``: arrays of (start, ord, end, cut), sorted by start and kind.

    Stretches that the models call random are added with kind ``random``; they are looked for where no fixed pattern is.
    The two columns replace any of these names. A null text is empty. Texts may be of any length; nothing is cut off, and time grows with
    the text and not with the square of its matches. Each row is handled on its own, without a shuffle, so repeated rows and null ids
    need no care.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    with_base = docs.withColumn("_base", F.array_sort(base_spans(content)))
    blank = replaced(content, F.col("_base"), lambda at, start, end: F.repeat(F.lit(" "), F.greatest(F.lit(0), end - F.greatest(at, start)).cast("int")))

    def added(m: Column) -> Column:
        return F.transform(random_stretches(m["found"], model, min_length, threshold), lambda s: F.struct(
            (m["start"] + s["start"]).alias("start"), F.lit(3).alias("ord"), (m["start"] + s["end"]).alias("end"),
            (m["start"] + s["start"]).alias("cut")))

    random = F.flatten(F.transform(let(blank, lambda t: _at(t, TOKEN % min_length)), added))
    return with_base.withColumn("_spans", F.array_sort(F.concat("_base", random)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def fit(docs: DataFrame, text: str = "text") -> list[float]:
    """Train both models: random strings from digests, ordinary identifiers from the documents themselves."""
    spark, words = docs.sparkSession, ordinary_identifiers(docs, text)
    upper = words.where(F.pmod(F.xxhash64("s"), F.lit(4)) == 0).select(F.upper("s").alias("s"))
    return train(random_strings(spark), words.unionByName(upper).unionByName(ordinary_patterns(spark)))


def redacted(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by ``mark``; the name before an assigned value stays.

    Overlapping secrets are covered by one mark. A null text stays null. All columns of the documents stay, whatever their names.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{text}`").alias("text"))
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["cut"].alias("start"), s["end"].alias("end"))))
    found = secret_spans(row, model).withColumn("_spans", ordered)
    clean = replaced(F.col("text"), F.col("_spans"), lambda at, start, end: F.when(start >= at, F.lit(mark)).otherwise(""))
    return found.withColumn("text", clean).select(*(
        F.col("text").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns))
