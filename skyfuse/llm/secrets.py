"""Secret scans: four fixed patterns, and long tokens that a character Markov
model of random strings explains better than one of ordinary identifiers.

DataFrame operations throughout. Splitting a text at a pattern gives what lies
between the matches; the lengths of pieces and matches give the positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfuse.llm.common import table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of a run of these characters, only its first AKIA can start a long enough match
HEX = r"[0-9a-f]{24,}"  # a match of [0-9a-f]+ is a whole run
LONG = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # state 0: any other character

#: Words of which the ordinary samples are made.
ORDINARY = (
    "the and that with from this have which their there other about after would these could first into than only more some such time people over then "
    "get set user name value index count list table column row file path config default option result error message request response handler server client "
    "connection session token buffer stream reader writer parser number string integer boolean array object context manager factory service controller "
    "information international understanding development government environment representation transformation configuration implementation responsibility "
    "und der die das nicht mit sich auf eine werden haben einer verschiedenen entwicklung gesellschaft les des une dans pour avec sont développement gouvernement "
    "para como los una del con desarrollo gobierno informacion"
)
SAMPLES = 2000
CHUNK = 64


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, random): n strings of digest characters in several alphabets, and n
    identifiers of two to four ordinary words, drawn by hashing the row's number."""
    i = F.col("id").cast("string")
    digest = F.sha2(i, 256)
    coded = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = F.element_at(F.array(digest, coded, F.translate(coded, "+/", "-_"), F.upper(F.translate(coded, "+/", "xY"))), (F.col("id") % 4 + 1).cast("int"))
    words = F.array(*[F.lit(w) for w in dict.fromkeys(ORDINARY.split())])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    four = F.array(*[word(k) for k in range(4)])
    own = F.slice(four, 1, (F.col("id") % 3 + 2).cast("int"))
    plain = F.element_at(F.array(F.array_join(own, "_"), F.array_join(own, ""), F.array_join(F.transform(own, lambda w: F.initcap(w)), ""), F.array_join(own, "-"), F.upper(F.array_join(own, "_"))), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(n)
    return rows.select(random.alias("text"), F.lit(True).alias("random")).union(rows.select(plain.alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step between characters, STATES x STATES of
    them: the counts reach the driver, as many whatever the number of samples."""
    steps = samples.where("length(text) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair"))
    a, b = F.expr(f"locate(substr(pair, 1, 1), '{ALPHABET}')"), F.expr(f"locate(substr(pair, 2, 1), '{ALPHABET}')")
    counts = {True: [1.0] * STATES**2, False: [0.2] * STATES**2}
    for r in steps.groupBy("random", a.alias("a"), b.alias("b")).count().collect():
        counts[r["random"]][r["a"] * STATES + r["b"]] += r["count"]
    out = []
    for i in range(STATES):
        rows = {k: counts[k][i * STATES : (i + 1) * STATES] for k in counts}
        out += [math.log(x / sum(rows[True])) - math.log(y / sum(rows[False])) for x, y in zip(rows[True], rows[False], strict=True)]
    return out


def _scan(items: Column, start: Column, step, kind: str, bind=None) -> Column:
    """Outputs, of type `kind`, of step(state, item) -> (state, output) along an array. Outputs are
    gathered in arrays of CHUNK: appending to one array copies it each time. With bind, step
    also gets bind(state, items), worked out once for CHUNK items."""
    none, lists = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def some(acc, chunk):
        def inner(bound):
            def one(got, x):
                state, out = step(got["state"], x, bound) if bind else step(got["state"], x)
                return F.struct(state.alias("state"), F.concat(got["out"], F.array(out)).alias("out"))

            return F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), one)

        done = F.transform(F.array(bind(acc["state"], chunk) if bind else F.lit(0)), inner)
        return F.element_at(F.transform(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), 1)

    def scan(held):  # one variable: what makes the array is worked out once, not for each chunk
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(held), F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: F.slice(held, i * CHUNK + 1, F.lit(CHUNK)))
        return F.flatten(F.aggregate(chunks, F.struct(start.alias("state"), lists.alias("out")), some, lambda acc: acc["out"]))

    return F.element_at(F.transform(F.array(items), scan), 1)


SPAN = "struct<start:long,kind:int,end:long>"


def _matches(text: Column, pattern: str, kind: str, least: int = 0, group: int = 0, keep=None) -> Column:
    """Spans (start, place of the kind, end) of a pattern's matches, in order."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    own = F.regexp_extract_all(text, F.lit(pattern), group) if group else hits
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), own.alias("own"))

    def step(at, x):
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        good = F.length(x["own"]) >= least if keep is None else keep(x["own"])
        span = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("long").alias("end"))
        return F.coalesce(end, at).cast("long"), F.when(x["hit"].isNotNull() & good, span)

    found = F.filter(_scan(both, F.lit(0).cast("long"), step, SPAN), lambda x: x.isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _apart(base: Column, more: Column) -> Column:
    """Both lists in order, without spans of the second that overlap one of the first: none of
    the first may reach beyond where such a span starts, from before, or start before it ends."""
    markov, flagged = KINDS.index("markov"), "struct<x:" + SPAN + ",good:boolean>"
    every = F.array_sort(F.concat(base, more))

    def before(end, x):
        good = (x["kind"] != markov) | (x["start"] >= end)
        return F.when(x["kind"] != markov, F.greatest(end, x["end"])).otherwise(end), F.struct(x.alias("x"), good.alias("good"))

    def after(start, y):
        x = y["x"]
        good = y["good"] & ((x["kind"] != markov) | (x["end"] <= start))
        return F.when(x["kind"] != markov, F.least(start, x["start"])).otherwise(start), F.struct(x.alias("x"), good.alias("good"))

    once = F.reverse(_scan(every, F.lit(0).cast("long"), before, flagged))
    twice = _scan(once, F.lit(2**62).cast("long"), after, flagged)
    return F.when((F.size(base) == 0) | (F.size(more) == 0), every).otherwise(F.reverse(F.transform(F.filter(twice, lambda y: y["good"]), lambda y: y["x"])))


def _llr(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's steps."""
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda s, i: s + F.element_at(values, at(i) * STATES + at(i + 1) + 1))
    return total / (F.length(token) - 1)


def secrets(docs: DataFrame, samples: DataFrame | None = None, margin: float = 0.5) -> DataFrame:
    """docs with spans: array of (kind, start, end) in code points, end exclusive,
    by start, then kind. Kinds: assign, access and hex by their patterns; markov:
    tokens of 20 and more characters, outside the others, whose mean ratio per step
    is `margin` or more under models trained from `samples` (text, random).

    docs needs text; all columns stay, but one named spans gives way. Null and empty
    texts have no spans; repeated rows are scanned alike; an empty table gives an
    empty one. The cost of a text grows with its length, and little faster with its
    number of matches; very long texts are scanned whole."""
    model = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_matches(text, ASSIGN, "assign", 6, 2), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex"))
    found = docs.drop("spans").withColumn("__base", base).withColumn("__more", _matches(text, LONG, "markov", keep=lambda t: _llr(t, model) >= margin))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = lambda x: F.struct(F.element_at(names, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    return found.withColumn("spans", F.transform(_apart(F.col("__base"), F.col("__more")), named)).drop("__base", "__more")


def redact(scanned: DataFrame) -> DataFrame:
    """The result of secrets() with every span of text replaced by its kind in
    angle brackets; spans that overlap become one."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def part(at, chunk):
        """The text that some spans lie in: places far into a text take long to find."""
        return F.struct(at.alias("at"), text.substr((at + 1).cast("int"), (F.array_max(F.transform(chunk, lambda x: x["end"])) - at).cast("int")).alias("text"))

    def step(at, x, near):
        between = near["text"].substr((at - near["at"] + 1).cast("int"), F.greatest(x["start"] - at, F.lit(0)).cast("int"))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.concat(between, F.lit("<"), x["kind"], F.lit(">"))).otherwise("")

    pieces = _scan(F.col("spans"), F.lit(0).cast("long"), step, "string", part)
    rest = text.substr((F.array_max(F.transform("spans", lambda x: x["end"])) + 1).cast("int"), F.length(text))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))


def op7_secrets(spark, sf_dir):
    out = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
