"""Secret scans: fixed shapes of secrets, and a battery of randomness tests.

The shapes (assignments, access ids, hexadecimal runs) give the base spans. Other long
tokens are judged by how random their characters are: an encoding is inferred from the
characters in use, and the token is tested for uniform use of the alphabet
(chi-squared), for runs above and below its middle, and for correlation of neighbours.
The three p-values are combined by Fisher's rule.

A token that passes them may still be a word: short words often do. So it is also
weighed against a model of ordinary words, pairs of letters as in the words of the corpus
and in a list below. The likelihood as a word over that as random characters is a p-value
of the word model (Markov's inequality), and of the different tokens of one class of
length and encoding those are discoveries that the Benjamini-Hochberg rule allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.staging import stage

# What the shapes of secrets look like.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
SHORT = r"(?<![A-Za-z0-9+/_-])[A-Za-z][a-z]{2,14}(?![A-Za-z0-9+/_-])"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the narrowest: what a token may hold, and its alphabet in order.
ENCODINGS = [
    (r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    (r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    (r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"", UPPER + LOWER + DIGITS + "-_"),
]

# Lengths in classes of eight, the longest together: at most this many classes.
CLASS_WIDTH, CLASSES = 8, 64
# Thresholds are looked for in steps of 1/8 of -ln(p), up to a p-value far below any needed.
STEPS = 8
MOST = 200 * STEPS
# Words that the model of words knows without a corpus.
WORDS = """the and that have with this from they which would there their about other
version file name long here number system first people could should through between
because information different government development something important without another
general international particular following together understand question possible available
management configuration application environment description performance language message
und die der das nicht werden haben eine einen einer sein schon durch zwischen gesellschaft
entwicklung wirtschaft verantwortung geschichte wissenschaft regierung verschieden moeglich
les des une pour dans avec cette sont plus comme leurs entre gouvernement developpement
premiere organisation toujours beaucoup quelque los las para como pero este esta sobre
tambien desarrollo gobierno informacion nosotros siempre trabajo universidad"""
# Fixed values of that model: chances that the kind of character (letter, digit, sign)
# stays, that a letter keeps the case of the one before, and the weight of a pair as such.
KIND_STAYS, CASE_STAYS, PAIR = 0.85, 0.9, 0.98
BLOCK = 64


def found_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches.

    ``value`` is the match's group. Places come from the lengths of the matches and of
    the text between them, added up block by block, so that the work for a text with
    very many matches stays far below the square of their number.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)

    def placed(m: Column) -> Column:
        steps = F.transform(m["whole"], lambda w, k: F.length(F.get(m["between"], k)) + F.length(w))
        return let(steps, lambda s: let(blocks(s), lambda b: spans(m, s, b)))

    def blocks(steps: Column) -> Column:
        """Where each block of matches begins."""
        count = F.floor((F.size(steps) - 1) / BLOCK).cast("int")
        sums = F.transform(
            F.sequence(F.lit(0), count), lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK))
        )
        return F.aggregate(
            sums,
            F.array(F.lit(0)),
            lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
        )

    def spans(m: Column, steps: Column, begins: Column) -> Column:
        def one(w: Column, k: Column) -> Column:
            block = F.floor(k / BLOCK).cast("int")
            end = F.get(begins, block) + total(
                F.slice(steps, block * BLOCK + 1, k - block * BLOCK + 1)
            )
            return F.struct(
                (end - F.length(w)).alias("start"), end.alias("end"), F.get(m["value"], k).alias("value")
            )

        return F.transform(m["whole"], one)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    matched = let(F.struct(between.alias("between"), whole.alias("whole"), value.alias("value")), placed)
    return F.when(F.rlike(text, F.lit(pattern)), matched).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each shape; an assignment counts if its value is long enough."""
    assigned = F.filter(found_spans(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_ASSIGNED)
    found = (assigned, found_spans(text, ACCESS), found_spans(text, HEX))

    def of_kind(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind")))

    return {kind: of_kind(found[k], k) for k, kind in enumerate(KINDS[:3])}


def upper_tail(z: Column) -> Column:
    """Chance of a standard normal number above ``z`` (error below 1e-7)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    # The coefficients of the usual five-term approximation.
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(token: Column) -> Column:
    """The alphabet of the narrowest encoding that the token can be written in."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(F.rlike(token, F.lit(pattern)), F.lit(letters)).otherwise(alphabet)
    return alphabet


def without(text: Column, part: Column) -> Column:
    return F.replace(text, part, F.lit(""))


def randomness(token: Column) -> Column:
    """-ln of the combined p-value of the three tests: near 0 for random characters.

    A token whose characters all lie in one half of the alphabet, or are all the same,
    has a p-value of 0 in the tests that need both.
    """
    least = 1e-30

    def tested(b: Column, alphabet: Column) -> Column:
        n, k = F.length(b).cast("double"), F.length(alphabet).cast("double")
        half = F.floor(k / 2).cast("int")
        sides = F.call_function(
            "translate",
            b,
            alphabet,
            F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), F.length(alphabet) - half)),
        )
        uses = F.transform(F.split(alphabet, ""), lambda c: n - F.length(without(b, c)))
        values = F.transform(F.split(b, ""), lambda c: F.position(c, alphabet).cast("double"))
        held = F.struct(
            n.alias("n"),
            k.alias("k"),
            F.aggregate(uses, F.lit(0.0), lambda a, u: a + u * u).alias("squares"),
            F.length(without(sides, F.lit("0"))).cast("double").alias("ones"),
            sides.alias("sides"),
            values.alias("values"),
            (F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n).alias("mean"),
        )
        return let(held, lambda m: let(F.array(chi_squared(m), runs(m), serial(m)), fisher))

    def chi_squared(m: Column) -> Column:
        statistic = m["k"] * m["squares"] / m["n"] - m["n"]
        spread = F.sqrt(2 * (m["k"] - 1) * (m["n"] - 1) / m["n"])
        return upper_tail((statistic - (m["k"] - 1)) / spread)

    def runs(m: Column) -> Column:
        changes = F.lit(0)
        for step in ("01", "10"):
            changes = changes + (m["n"] - F.length(without(m["sides"], F.lit(step)))) / 2
        both = 2 * m["ones"] * (m["n"] - m["ones"])
        spread = F.sqrt(both * (both - m["n"]) / (m["n"] * m["n"] * (m["n"] - 1)))
        z = (1 + changes - (both / m["n"] + 1)) / spread
        return F.when(both <= m["n"], F.lit(0.0)).otherwise(2 * upper_tail(F.abs(z)))

    def serial(m: Column) -> Column:
        off = F.transform(m["values"], lambda v: v - m["mean"])
        spread = F.aggregate(off, F.lit(0.0), lambda a, v: a + v * v)
        follow = F.zip_with(
            off, F.slice(off, 2, F.size(off)), lambda a, b: a * F.coalesce(b, F.lit(0.0))
        )
        z = (F.aggregate(follow, F.lit(0.0), lambda a, v: a + v) / spread + 1 / m["n"]) * F.sqrt(m["n"])
        return F.when(spread == 0, F.lit(0.0)).otherwise(2 * upper_tail(F.abs(z)))

    def fisher(p: Column) -> Column:
        logs = F.transform(p, lambda x: -F.ln(F.greatest(x, F.lit(least))))
        half = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)
        return half - F.ln(1 + half + half * half / 2)

    body = F.regexp_replace(token, "=+$", "")
    return let(body, lambda b: let(encoding(b), lambda alphabet: tested(b, alphabet)))


def pair_logs(docs: DataFrame) -> list[float]:
    """ln of the chance of a letter after a letter, or first (place 0), 27 to a row.

    Learned from the words of fewer than 16 letters, which can't be tokens: different
    words, weighed by the logarithm of their number. At most 27 x 26 sums come to the
    driver.
    """
    found = F.regexp_extract_all("text", F.lit(SHORT), F.lit(0))
    words = docs.select(F.explode(found).alias("w"))
    words = words.select(F.lower("w").alias("w")).groupBy("w").agg(F.log1p(F.count(F.lit(1))).alias("n"))
    padded = F.concat(F.lit("^"), F.col("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring(padded, k, F.lit(2)))
    sums = words.select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    counts = {r["p"]: r["n"] for r in sums.collect()}
    for word in WORDS.split():
        for pair in zip("^" + word, word):
            counts["".join(pair)] = counts.get("".join(pair), 0.0) + 1.0
    logs = []
    for before in "^" + LOWER:
        total = sum(counts.get(before + c, 0.0) for c in LOWER)
        share = [counts.get(before + c, 0.0) / total if total else 1 / 26 for c in LOWER]
        logs += [0.0, *[math.log(PAIR * x + (1 - PAIR) / 26) for x in share]]
    return logs


def unlike_words(token: Column, logs: list[float]) -> Column:
    """ln of the likelihood as random characters of its encoding over that as words."""
    table = F.lit(logs)

    def kind(c: Column) -> Column:
        return F.when(c["at"] > 0, 0).when(F.position(c["c"], F.lit(DIGITS)) > 0, 1).otherwise(2)

    def one(c: Column, before: Column) -> Column:
        same = kind(c) == kind(before)
        stays = F.when(same, math.log(KIND_STAYS)).otherwise(math.log((1 - KIND_STAYS) / 2))
        case = F.when(c["up"] == before["up"], math.log(CASE_STAYS)).otherwise(math.log(1 - CASE_STAYS))
        letter = F.get(table, before["at"] * 27 + c["at"]) + F.when(before["at"] > 0, case).otherwise(math.log(0.5))
        of_kind = F.when(c["at"] > 0, letter).when(kind(c) == 1, -math.log(10)).otherwise(-math.log(4))
        return of_kind + stays

    def weighed(b: Column, alphabet: Column) -> Column:
        signs = F.transform(
            F.split(b, ""),
            lambda c: F.struct(
                c.alias("c"), F.position(F.lower(c), F.lit(LOWER)).alias("at"), (F.lower(c) != c).alias("up")
            ),
        )
        first = F.struct(F.lit("-").alias("c"), F.lit(0).alias("at"), F.lit(False).alias("up"))
        parts = let(signs, lambda s: F.zip_with(s, F.slice(F.concat(F.array(first), s), 1, F.size(s)), one))
        as_words = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return -as_words - F.length(b) * F.ln(F.length(alphabet).cast("double"))

    body = F.regexp_replace(token, "=+$", "")
    return let(body, lambda b: let(encoding(b), lambda alphabet: weighed(b, alphabet)))


def tokens(text: Column, logs: list[float]) -> Column:
    """``array<struct<start, end, hash, class, step, proof>>`` of the long tokens.

    ``class`` numbers the length and encoding, ``step`` is how far the tests are from
    random characters, ``proof`` how far the token is from words. Tokens of digits alone
    are numbers, and left out.
    """
    has_letter = lambda s: F.rlike(s["value"], F.lit("[A-Za-z]"))
    alphabets = F.lit([letters for _, letters in ENCODINGS])

    def one(s: Column) -> Column:
        length = F.least(F.floor(F.length(s["value"]) / CLASS_WIDTH), F.lit(CLASSES - 1))
        form = F.array_position(alphabets, encoding(F.regexp_replace(s["value"], "=+$", ""))) - 1
        proof = F.least(F.floor(unlike_words(s["value"], logs) * STEPS), F.lit(MOST))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.xxhash64(s["value"]).alias("hash"),
            (length * len(ENCODINGS) + form).cast("int").alias("class"),
            F.floor(randomness(s["value"]) * STEPS).cast("int").alias("step"),
            proof.cast("int").alias("proof"),
        )

    return F.transform(F.filter(found_spans(text, TOKEN), has_letter), one)


def thresholds(scanned: DataFrame, fdr: float, alpha: float) -> DataFrame:
    """``(class, least)``: the least proof that makes a token of the class a discovery.

    Benjamini-Hochberg over the different tokens of a class, from a histogram of at most
    ``MOST`` steps: p-values are rounded up, those of tokens that fail the tests are 1.
    """
    found = scanned.select(F.explode("_tokens").alias("t")).select("t.hash", "t.class", "t.step", "t.proof")
    random = F.col("step") <= int(-math.log(alpha) * STEPS)
    proof = F.when(random, F.greatest("proof", F.lit(0))).otherwise(0)
    steps = found.distinct().groupBy("class", proof.alias("proof")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("class")
    down = whole.orderBy(F.desc("proof")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"tested": F.sum("n").over(whole), "beyond": F.sum("n").over(down)})
    allowed = steps.filter(F.exp(-F.col("proof") / STEPS) * F.col("tested") <= fdr * F.col("beyond"))
    return allowed.filter("proof > 0").groupBy("class").agg(F.min("proof").alias("least"))


def examined(docs: DataFrame) -> DataFrame:
    """``docs`` with the base spans in order as ``base`` and their long tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = F.transform(
        F.concat(*base_spans(text).values()),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    rows = docs.drop("base", "spans", "_tokens")
    return rows.withColumn("base", F.array_sort(ordered)).withColumn("_tokens", tokens(text, pair_logs(docs)))


def decided(rows: DataFrame, fdr: float, alpha: float) -> DataFrame:
    """``rows``, a written table of :func:`examined`, with ``spans`` for its tokens.

    The thresholds that come to the driver are at most one number for each class.
    """
    least = {row["class"]: row["least"] for row in thresholds(rows, fdr, alpha).collect()}
    limits = F.lit([least.get(k, MOST + 1) for k in range(CLASSES * len(ENCODINGS))])
    random = int(-math.log(alpha) * STEPS)

    def accepted(t: Column) -> Column:
        near = F.exists("base", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"]))
        return (t["step"] <= random) & (t["proof"] >= F.get(limits, t["class"])) & ~near

    added = F.transform(
        F.filter("_tokens", accepted),
        lambda t: F.struct(
            t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")
        ),
    )
    return rows.withColumn("spans", F.array_sort(F.concat("base", added))).drop("_tokens")


def scan(docs: DataFrame, fdr: float = 0.05, alpha: float = 0.01) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end), in order.

    ``base`` has the spans of the shapes. ``spans`` adds the tokens that pass the tests
    at ``alpha`` and the threshold of their class, unless they overlap a base
    span. ``kind`` is a place in ``KINDS``; places count code points, the end is
    exclusive. Null and empty texts have no spans; repeated rows are scanned each and
    count each; other columns are passed on (``base`` and ``spans`` are replaced); an
    empty table gives an empty result.
    """
    return decided(stage(examined(docs), "scanned"), fdr, alpha)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are one."""
    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.when(
            fresh, F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        ).otherwise("")
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.concat(state["pieces"], F.array(piece)).alias("pieces"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array(F.lit("")).alias("pieces"))
    done = F.aggregate(
        spans,
        start,
        step,
        lambda state: F.concat(
            F.array_join(state["pieces"], ""), F.substring(text, state["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base spans, their digest, and all spans."""
    scanned = stage(examined(docs.select("doc_id", "text")).drop("text"), "scanned")
    found = decided(scanned, fdr=0.05, alpha=0.01)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
