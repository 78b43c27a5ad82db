"""Secrets in texts, by patterns and by a battery of randomness tests. DataFrame functions only.

Patterns give the base spans: assignments, access keys and long hexadecimal runs. The battery then looks at every other
token of 20 or more characters out of letters, digits and ``+/_-``. From its characters it infers the encoding with the
smallest alphabet that holds them all, and tests

* uniformity: Pearson's chi-squared of the character counts against that alphabet,
* runs: the number of runs of letters and non-letters (and of upper and lower case) against the number
  expected of a random order,
* serial correlation: of neighbouring characters' places in the alphabet.

Each gives a normal score of being further from a random string than chance would have it; a token that fails any of them is no
secret. What passes is then tested the other way round: how likely would a token of ordinary text with this length and encoding
look so unlike text? Its statistic is the mean cost of a character under a model of ordinary tokens (classes of neighbouring characters, pairs of
letters without case), less that of a random character of the encoding. NULL has the mean and spread by encoding and length that ordinary tokens
of 20 characters and more have; the p-value is the normal tail beyond them. Digits with separators alone are numbers and dates, never secrets.
Of a document's tokens, the Benjamini-Hochberg rule at rate FDR, over all candidates that it has, keeps the share of false discoveries low.

A document is one row throughout: no shuffle, no state. Positions are code points, ends are exclusive. Work grows with a text's length, and but for gathering
runs of square-root size with its tokens too, however many there are: spans and tokens meet in one sweep, and what lambdas share is evaluated once.

Defined results: a null text counts as empty; a text without spans gives the hash of no bytes and an empty list; tokens of equal p are found or
left together; repeated rows each get a row; very long texts are searched as a whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daqframe.llm.sampling import unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run that is too short can hold no longer match, so the least length may stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
FDR = 1e-5
REJECT = 3.5
SPAN = "array<struct<start:int,kind:int,end:int>>"
# A model of ordinary tokens, of 34,422 long tokens of source code and documents and the words of message catalogues in many languages.
# PAIRS: for each letter (a row) the cost of each next one, cases alike, in quarter bits from "#" on; FIRST: of a letter after none. CLASSES: bits of lower, upper, digit, other after each.
PAIRS = [
    "=754A>7A8?803/G7J/2/::A@;>",
    "-@7A.DBA/6F/E?2BL48@0H@D8J",
    "/@9@0EJ.1E46;E-@P4917IOC@B",
    ".>?7*=A:.AC:><1?N86;5AAJ@C",
    "7=44;:9B;B936.A:?-01A:@6<?",
    "1C>@03@E+GG4E:.?L2:72FHL;L",
    "0@:@+A:71CB0=43?F2593CBG>L",
    "+EC?+CFC0CA::=/BO5646B@Q=O",
    "6845596EB?845,29F721?9I?B9",
    ",F;:*AGG4C;=A708AB1=2@CJFB",
    "/C6;+C?<.G<7<71>P8563A=M?H",
    ".>?6,?<B-B@2>>0>PD654<FP;L",
    "+4A<+AAB0LE;7<10OC7?5EGICM",
    "1C3009/C2@<>@:4>MA2.6;HH=D",
    "<854><:D;=832,:5K.36689ED@",
    "-D>>.=D:3K:3D>/5L.845HIR7P",
    "8F9><JHE=HD1CA?DA;?;%HALFJ",
    ".?88,?:C/F:;7:0>J6537<BO8C",
    "3D6B/?C70G34;;56A>1-5BBN<?",
    ".C<A,AE5-H@:@@1>P1665CD?7>",
    "67963::E5?912/>4O020@>D=D>",
    "+E;G)DGJ.JD@8;36P<<@<FDE>J",
    "+B;</EB:+ME>C51@J37?=JFF9H",
    "1>4?/=G:0OC>:B80K?9*9GB5;P",
    "/:782<:?5@;7444,F:229@>EB@",
    "-?C>(H@?0F>:=94>JB:;8@@J=8",
]
FIRST = "3704546;3B=64572D5039:9=JH"
CLASSES = [[0.25, 4.65, 6.51, 3.23], [3.27, 0.44, 5.8, 2.8], [3.51, 4.65, 0.77, 1.81], [0.8, 1.38, 5.22, 6.01]]
# mean of ordinary tokens' statistic, and its variance by characters and between tokens: one case; one case and digits; both cases; both cases and digits
NULL = [(-0.57, 2.52, 0.02), (-0.5, 0.5, 0.153), (-0.87, 5.49, 0.047), (-1.13, 10.33, 0.02)]
LOWEST, HIGHEST = ord("+"), ord("z")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once, wherever and however often body names it. An expression in a lambda would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], element: str) -> Column:
    """What the steps emit: step gets a state and an item, and gives the next state and an array of element.

    Items are folded in runs of about the square root of their number, so that gathering copies little.
    """
    none = F.array().cast(f"array<{element}>")

    def inner(acc: Column, x: Column) -> Column:
        after, emitted = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], emitted.cast(f"array<{element}>")).alias("out"))

    def outer(acc: Column, run: Column) -> Column:
        done = F.aggregate(run, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def runs(every: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(every))).cast("int")
        return let(size, lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / c).cast("int")), lambda k: F.slice(every, k * c + 1, c)))

    def whole(every: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{element}>>").alias("out"))
        return F.when(F.size(every) > 0, F.flatten(F.aggregate(runs(every), start, outer)["out"])).otherwise(none)

    return let(items, whole)


MATCH = "struct<start:int,end:int,match:string>"


def located(text: Column, pattern: str) -> Column:
    """All matches, leftmost first and without overlap: structs of start, end and the matched text.

    The pieces between matches and the matches themselves add up to the positions.
    """

    def zipped(matches: Column) -> Column:
        return F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("piece"), matches.alias("match"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        first = at + F.char_length(x["piece"])
        end = first + F.char_length(x["match"])
        return end, F.array(F.struct(first.alias("start"), end.alias("end"), x["match"].alias("match")))

    return folded(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped), F.lit(0), step, MATCH)


def spans_of(text: Column, pattern: str, kind: int, least: Column | None = None) -> Column:
    """Spans of a kind; none where a quick search finds no match at all."""
    found = located(text, pattern)
    if least is not None:
        found = F.filter(found, lambda x: F.char_length(F.regexp_extract(x["match"], pattern, 2)) >= least)
    marked = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), marked.cast(SPAN)).otherwise(F.array().cast(SPAN))


def tail(z: Column) -> Column:
    """An upper bound of the normal tail beyond z, close for z of 0 and more; 1 below."""
    return F.when(z < 0, 1.0).otherwise(F.exp(-z * z / 2) * (4 / 2.5066282746310002) / (z * 3 + F.sqrt(z * z + 8)))


def cost_of(a: str, b: str) -> float:
    """Bits of character b after a in ordinary tokens."""

    def kind(c: str) -> int:
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3

    bits = CLASSES[kind(a)][kind(b)]
    if b.isalpha():
        row = PAIRS[ord(a.lower()) - ord("a")] if a.isalpha() else FIRST
        return bits + (ord(row[ord(b.lower()) - ord("a")]) - ord("#")) / 4
    return bits + (3.32 if b.isdigit() else 2.0)


def costs() -> Column:
    """cost_of for each two characters from LOWEST to HIGHEST, as one literal array."""
    every = [chr(c) for c in range(LOWEST, HIGHEST + 1)]
    return F.split(F.lit(",".join(f"{cost_of(a, b):.2f}" for a in every for b in every)), ",").cast("array<double>")


def tested(candidates: Column) -> Column:
    """Structs of start, end and p for located candidate tokens."""

    table, width = costs(), HIGHEST - LOWEST + 1

    def count(token: Column, letters: str) -> Column:
        return F.char_length(token) - F.char_length(F.regexp_replace(token, letters, ""))

    def shapes(x: Column) -> Column:
        token = x["match"]
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "0"), "[+/_-]", "-"), "[A-Z]", "A"), "[a-z]", "a")
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), token.alias("token"), F.char_length(token).cast("double").alias("n"),
            count(token, "[a-z]").alias("lower"), count(token, "[A-Z]").alias("upper"), count(token, "[0-9]").alias("digit"), count(token, "[+/]").alias("plus"), count(token, "[_-]").alias("dash"),
            (F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1).cast("double").alias("changes"),
            F.filter(F.split(token, ""), lambda c: c != "").alias("chars"),
        )

    def sums(x: Column) -> Column:
        token, n = x["token"], x["n"]
        def some(name: str, size: int) -> Column:
            return F.when(x[name] > 0, size).otherwise(0)

        alphabet = (
            F.when(token.rlike("^[0-9]+$"), 10).when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+$") & (x["digit"] > 0), 32)
            .otherwise(some("lower", 26) + some("upper", 26) + some("digit", 10) + some("plus", 2) + some("dash", 2))
        ).cast("double")
        squares = F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        kept = F.aggregate(F.array(x["lower"], x["upper"], x["digit"], x["plus"] + x["dash"]), F.lit(0.0), lambda acc, c: acc + c.cast("double") * (c - 1))
        codes = F.transform(x["chars"], lambda c: F.ascii(c).cast("double"))
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c) / n
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), alphabet.alias("k"), (alphabet * squares / n - n).alias("chi"),
            F.when((x["lower"] > 0) & (x["upper"] > 0), 2).otherwise(0).alias("cases"), F.when(x["digit"] > 0, 1).otherwise(0).alias("digits"),
            x["changes"].alias("changes"), (1 - kept / (n * (n - 1))).alias("expected"), codes.alias("codes"), mean.alias("mean"),
        )

    def scores(x: Column) -> Column:
        n, k = x["n"], x["k"]
        uniform = (x["chi"] - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        runs = (x["changes"] - (n - 1) * x["expected"]) / F.sqrt((n - 1) * x["expected"] * (1 - x["expected"]) + 0.25)
        inner = F.slice(x["codes"], 1, F.size(x["codes"]) - 1)
        outer = F.slice(x["codes"], 2, F.size(x["codes"]) - 1)
        mean = x["mean"]
        covariance = F.aggregate(F.arrays_zip(inner.alias("a"), outer.alias("b")), F.lit(0.0), lambda acc, y: acc + (y["a"] - mean) * (y["b"] - mean))
        variance = F.aggregate(x["codes"], F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
        serial = F.when(variance > 0, covariance / variance * F.sqrt(n)).otherwise(99.0)
        at = F.transform(F.arrays_zip(inner.alias("a"), outer.alias("b")), lambda y: ((y["a"] - LOWEST) * width + y["b"] - LOWEST).cast("int"))
        bits = F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / (n - 1) - F.log2(k)
        null = F.element_at(F.array(*(F.array(*(F.lit(v) for v in row)) for row in NULL)), x["cases"] + x["digits"] + 1)
        unlike = (bits - null[0]) / F.sqrt(null[1] / (n - 1) + null[2])
        random = (k >= 16) & (uniform <= REJECT) & (F.abs(runs) <= REJECT) & (F.abs(serial) <= REJECT)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(random, tail(unlike)).otherwise(1.0).alias("p"))

    return F.transform(F.transform(F.transform(candidates, shapes), sums), scores)


def discovered(tests: Column) -> Column:
    """The Benjamini-Hochberg rule: all with p up to the largest p that is at most FDR times its rank over the number of tests."""

    def largest(every: Column) -> Column:
        ordered = F.array_sort(F.transform(every, lambda x: x["p"]))
        passing = F.transform(ordered, lambda p, i: F.when(p <= F.lit(FDR) * (i + 1) / F.size(every), p))
        return F.coalesce(F.array_max(passing), F.lit(-1.0))

    return let(tests, lambda every: let(largest(every), lambda limit: F.filter(every, lambda x: x["p"] <= limit)))


def apart(tokens: Column, spans: Column) -> Column:
    """The tokens (disjoint, in order) that no span overlaps, by one sweep over both in order of start.

    A token waits until the next one: only spans that start before that can still touch it.
    """
    token = F.lit(len(KINDS))
    both = F.concat(
        F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), token.alias("kind"), x["end"].alias("end"), x["match"].alias("match"))),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(None).cast("string").alias("match"))),
        F.array(F.struct(F.lit(2**31 - 1).alias("start"), token.alias("kind"), F.lit(2**31 - 1).alias("end"), F.lit(None).cast("string").alias("match"))),
    )

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        is_token, waiting = x["kind"] == token, state["waiting"]
        this = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")).cast(MATCH)
        after = F.struct(
            F.when(is_token, state["reach"]).otherwise(F.greatest(state["reach"], x["end"])).alias("reach"),
            F.when(is_token & (x["start"] >= state["reach"]), this).when(~is_token & (x["start"] >= waiting["end"]), waiting).alias("waiting"),
        )
        return after, F.when(is_token & waiting.isNotNull(), F.array(waiting)).otherwise(F.array().cast(f"array<{MATCH}>"))

    start = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(MATCH).alias("waiting"))
    return F.when(F.size(spans) == 0, tokens).otherwise(folded(F.array_sort(both), start, step, MATCH))


def with_spans(documents: DataFrame, base_spans: str = "base_spans", all_spans: str = "all_spans") -> DataFrame:
    """documents with base_spans (of the patterns) and all_spans (with the battery's): sorted structs of start, kind and end.

    kind counts in KINDS. Columns of these names in the input are replaced.
    """
    text = F.coalesce(documents["text"], F.lit(""))
    base = F.array_sort(F.concat(spans_of(text, ASSIGN, 0, F.lit(8)), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))
    marked = documents.withColumn(base_spans, base)
    free = let(located(text, TOKEN), lambda tokens: apart(tokens, F.col(base_spans)))
    random = F.transform(discovered(tested(free)), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    more = F.when(text.rlike(TOKEN), random.cast(SPAN)).otherwise(F.array().cast(SPAN))
    return marked.withColumn(all_spans, F.array_sort(F.concat(base_spans, more)))


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256 and spans of every document."""
    found = with_spans(documents.select("doc_id", "text"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", number(0), number(1), number(2), F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


CHUNK = 256


def cut(chunks: Column, at: Column, size: Column) -> Column:
    """size code points from at on, of a text in chunks: a substring of the whole would count from its start each time."""
    first = F.floor(at / CHUNK).cast("int")
    near = F.slice(chunks, first + 1, F.floor((at + size - 1) / CHUNK).cast("int") - first + 1)
    return F.when(size > 0, F.array_join(near, "").substr(at % CHUNK + 1, size)).otherwise("")


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with each stretch of spans in text replaced by mark; null texts stay null."""
    base, spans = unused(documents, "base_spans"), unused(documents, "all_spans")
    text = F.col("text")

    def pieces(chunks: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            piece = F.concat(cut(chunks, at, x["start"] - at), F.lit(mark))
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(piece)).otherwise(F.array().cast("array<string>"))

        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(folded(F.col(spans), F.lit(0), step, "string"), ""), let(end, lambda at: cut(chunks, at, F.char_length(text) - at)))

    found = with_spans(documents, base, spans)
    clean = F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), pieces)).otherwise(text)
    return found.withColumn("text", clean).drop(base, spans)
