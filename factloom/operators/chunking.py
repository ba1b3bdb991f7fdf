"""The chunker: token features and a Naive Bayes model over them.

No feature of a token looks at the labels given to earlier tokens, so each token
is classified by itself and tagging is a join to the model, not a walk along the
sentence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.context import (
    END,
    START,
    is_code,
    set_ahead,
    tag_code,
    tags_ahead,
    tags_since,
)
from factloom.operators.lookup import (
    MAX_BROADCAST_BYTES,
    MAX_BROADCAST_ROWS,
    lookup_join,
    lookup_tokens,
    most_frequent,
)
from factloom.operators.sentences import SENTENCE_KEY, explode_rows
from factloom.staging import stage

# Feature names as the model stores them -> columns of the feature table.
FEATURES = {
    "pos": "pos",
    "word": "word",
    "prevpos": "prevpos",
    "nextpos": "nextpos",
    "prevpos+pos": "prevpos_pos",
    "pos+nextpos": "pos_nextpos",
    "tags-since-dt": "tags_since_dt",
}

TOKEN_KEY = (*SENTENCE_KEY, "tok_no")

# Added to every count before it is turned into a probability.
SMOOTHING = 0.5


def seen_tags(tagged: DataFrame, column: str = "tags", most: int = 256) -> list[str] | None:
    """The different tags of sentences, which should be a written table; None if they are more than ``most``."""
    tags = tagged.select(F.explode(F.array_distinct(column)).alias("tag")).filter("tag is not null")
    found = [r["tag"] for r in tags.distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def chunk_features(
    tagged: DataFrame,
    keep: Sequence[str] = (),
    placed: bool = True,
    tags: Sequence[str] | None = None,
    without: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, sent_no, tok_no, word, pos, …)``: one row of features per token.

    ``tagged`` sentences have ``words`` and ``tags``, and ``iob`` if they are to be
    learned from. Features are made inside the sentence's row, so nothing moves;
    with ``placed=False`` the (still compact) rows are spread by sentence first,
    and a later aggregate by sentence finds its rows in place.

    The columns ``keep`` travel as a struct ``kept`` on the first token only.

    If ``tags`` are given, all tags that occur or most of them, tags since a determiner come
    from a string with a letter per tag; only sentences with other tags, or very long ones,
    have lists of them made. Tokens with a ``word`` of the small table ``without`` are left out.
    """
    if not placed:
        tagged = tagged.repartition(*SENTENCE_KEY)
    lists = ["words", "tags", *(["iob"] if "iob" in tagged.columns else [])]
    # Each step is a projection of its own: what is used twice in one would be made twice.
    listed = tagged.select(*SENTENCE_KEY, *keep, *lists, tag_code(F.col("tags"), tags or ()).alias("_code"))
    coded = is_code(F.col("_code"), F.col("tags"))
    listed = listed.withColumns({"_code": F.when(coded, F.col("_code")), "_coded": coded})
    listed = listed.withColumn("_since", F.when(~F.col("_coded"), tags_since(F.col("tags"))))
    # Neighbours are looked up from the token, so that no list of them has to be made.
    whole = F.when(reduce(and_, [F.col(c).isNotNull() for c in lists]), F.col("words"))
    tokens = explode_rows(listed, ["*"], whole, "word", "tok_no")
    if without is not None:
        tokens = tokens.join(F.broadcast(without), "word", "left_anti")
    at, size = F.col("tok_no"), F.size("tags")
    before = F.when(at == 0, F.lit(START)).otherwise(F.get("tags", at - 1))
    after = F.when(at == size - 1, F.lit(END)).otherwise(F.get("tags", at + 1))
    tokens = tokens.withColumn("_ahead", tags_ahead(F.col("_code"), at, tags or ()))
    coded = F.when(F.col("_ahead").isNotNull(), set_ahead(F.col("_ahead"), tags or ()))
    tokens = tokens.select(
        *TOKEN_KEY,
        *([F.when(at == 0, F.struct(*keep)).alias("kept")] if keep else []),
        "word",
        F.get("tags", at).alias("pos"),
        before.alias("prevpos"),
        after.alias("nextpos"),
        F.coalesce(coded, F.get("_since", at)).alias("tags_since_dt"),
        *([F.get("iob", at).alias("iob")] if "iob" in lists else []),
    )
    return tokens.select(
        "*",
        F.concat_ws("+", "prevpos", "pos").alias("prevpos_pos"),
        F.concat_ws("+", "pos", "nextpos").alias("pos_nextpos"),
    )


def train_chunker(features: DataFrame, label: str = "iob") -> DataFrame:
    """The model: ``(fname, fval, label, n)`` counts.

    Counts are all there is to a Naive Bayes model; save it as a Parquet table.
    Every token has every feature, so a label's own count is the sum of its rows
    of any one feature.

    All features but the word are made of the few tags around a token. Tokens are
    first counted by word and by those tags, in one shuffle that combines on the
    map side; only the distinct combinations are then listed feature by feature.
    """
    tags = ["pos", "prevpos", "nextpos", "tags_since_dt"]
    combined = features.select("word", *tags, F.col(label).alias("label")).groupingSets(
        [["word", "label"], [*tags, "label"]], "word", *tags, "label"
    )
    counted = combined.agg(F.grouping("word").alias("_by_tags"), F.count(F.lit(1)).alias("n"))
    derived = {
        **{name: F.col(column) for name, column in FEATURES.items() if column in tags},
        "prevpos+pos": F.concat_ws("+", "prevpos", "pos"),
        "pos+nextpos": F.concat_ws("+", "pos", "nextpos"),
    }

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("fname"), value.alias("fval"))

    pairs = F.when(
        F.col("_by_tags") == 1, F.array(*[pair(name, value) for name, value in derived.items()])
    ).otherwise(F.array(pair("word", F.col("word"))))
    return (
        explode_rows(counted, ["label", "n"], pairs, "_f")
        .groupBy("_f.fname", "_f.fval", "label")
        .agg(F.sum("n").alias("n"))
    )


def log_probabilities(model: DataFrame) -> DataFrame:
    """``(fname, fval, label, n, logp)``, with ``fname`` null for a label's prior."""
    labels = model.filter(F.col("fname") == "pos").groupBy("label").agg(F.sum("n").alias("total"))
    bins = model.groupBy("fname").agg(F.countDistinct("fval").alias("bins"))
    n, total, size = F.col("n"), F.col("total"), F.col("bins")
    # One row per label and one per feature name.
    values = (
        model.join(F.broadcast(labels), "label")
        .join(F.broadcast(bins), "fname")
        .select(
            "fname",
            "fval",
            "label",
            "n",
            F.log((n + SMOOTHING) / (total + SMOOTHING * size)).alias("logp"),
        )
    )
    over_all = Window.partitionBy()
    prior = (total + SMOOTHING) / (
        F.sum("total").over(over_all) + SMOOTHING * F.count(F.lit(1)).over(over_all)
    )
    priors = labels.select(
        F.lit(None).cast("string").alias("fname"),
        F.lit(None).cast("string").alias("fval"),
        "label",
        total.alias("n"),
        F.log(prior).alias("logp"),
    )
    return values.unionByName(priors)


# The features that only look at a token's tag and its neighbours' tags.
CONTEXT = {"prevpos": "prevpos", "pos": "pos", "nextpos": "nextpos"}
# So many combinations of these three are scored beforehand, all of them or none.
MAX_CONTEXTS = 1_000_000
# Stands for a tag that the model has not seen.
UNSEEN = "\0"


@dataclass
class ChunkModel:
    """A model made ready for tagging.

    ``table`` has ``(fname, fval, l0, l1, …)``: the log probability of a value under
    each label. ``unseen`` holds, per feature name, that of a value without a row.
    ``contexts`` has ``(prevpos, pos, nextpos, l0, l1, …)``: what the features made of
    these three add up to, for each combination of the tags ``seen`` in each place; None
    if there are too many. ``broadcast`` says of each feature if its values may be.
    ``frequent`` has the rows of the most frequent words if not all words may be.
    """

    labels: list[str]
    priors: list[float]
    unseen: dict[str, list[float]]
    table: DataFrame
    broadcast: dict[str, bool]
    contexts: DataFrame | None
    seen: dict[str, list[str]]
    frequent: DataFrame | None = None

    def frequent_words(self) -> DataFrame | None:
        """``(word)``: the words that are broadcast if not all may be, else None."""
        if self.frequent is None or self.broadcast["word"]:
            return None
        return self.frequent.select(F.col("fval").alias("word"))


def load_chunker(model: DataFrame, max_labels: int = 256) -> ChunkModel:
    """Make the counts of a saved model ready; done once however often it is used.

    Only the header comes to the driver: one row per label and feature name. A model
    with more than ``max_labels`` labels is an error, as it is hardly one of chunk tags.
    """
    header = (
        model.groupBy("fname")
        .pivot("label", _labels(model, max_labels))
        .agg(F.sum("n"))
        .join(model.groupBy("fname").agg(F.countDistinct("fval").alias("_bins")), "fname")
        .filter(F.col("fname").isin(list(FEATURES)))
        .collect()
    )
    if not header:
        raise ValueError("the chunk model is empty")
    bins = {row["fname"]: row["_bins"] for row in header}
    totals = {c: header[0][c] or 0 for c in header[0].asDict() if c not in ("fname", "_bins")}
    everything = sum(totals.values()) + SMOOTHING * len(totals)

    def logp(label: str, total: int) -> Column:
        n = F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0))
        size = F.create_map(*[F.lit(x) for pair in bins.items() for x in pair])
        return F.log((n + SMOOTHING) / (F.lit(total) + SMOOTHING * F.element_at(size, F.col("fname"))))

    table = stage(
        model.groupBy("fname", "fval").agg(
            *[logp(label, n).alias(f"l{i}") for i, (label, n) in enumerate(totals.items())]
        ),
        "chunker",
    )
    unseen = {
        name: [math.log(SMOOTHING / (n + SMOOTHING * size)) for n in totals.values()]
        for name, size in bins.items()
    }
    contexts, seen = None, {}
    if math.prod(bins[name] + 1 for name in CONTEXT) <= MAX_CONTEXTS:
        # That is a few hundred tags at most.
        for name, fval in table.filter(F.col("fname").isin(list(CONTEXT))).select("fname", "fval").collect():
            seen.setdefault(name, []).append(fval)
        contexts = stage(_contexts(table, seen, unseen), "contexts")
    broadcast, frequent = _broadcasts(table), None
    if not broadcast.get("word", True):
        counted = model.filter("fname = 'word'").groupBy("fval").agg(F.sum("n").alias("n"))
        rows = table.filter("fname = 'word'").join(most_frequent(counted), "fval")
        frequent = stage(rows.select("fval", *[f"l{i}" for i in range(len(totals))]), "frequent")
    return ChunkModel(
        labels=list(totals),
        priors=[math.log((n + SMOOTHING) / everything) for n in totals.values()],
        unseen=unseen,
        table=table,
        broadcast=broadcast,
        contexts=contexts,
        seen=seen,
        frequent=frequent,
    )


def _broadcasts(table: DataFrame) -> dict[str, bool]:
    """Of each feature, whether its values are within the bounds of a broadcast."""
    labels = len(table.columns) - 2
    width = F.octet_length("fval") + 16 * (labels + 1)
    sizes = table.groupBy("fname").agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("size")).collect()
    return {r["fname"]: r["n"] <= MAX_BROADCAST_ROWS and r["size"] <= MAX_BROADCAST_BYTES for r in sizes}


def _contexts(table: DataFrame, seen: dict[str, list[str]], unseen: dict[str, list[float]]) -> DataFrame:
    """The table ``contexts`` of a model: every combination of seen tags, and unseen ones."""
    tags = {name: F.explode(F.array(*[F.lit(t) for t in [*seen[name], UNSEEN]])) for name in CONTEXT}
    rows = table.sparkSession.range(1).select()
    for name, each in tags.items():
        rows = rows.select("*", each.alias(name))
    rows = rows.withColumns({
        "prevpos+pos": F.concat_ws("+", "prevpos", "pos"), "pos+nextpos": F.concat_ws("+", "pos", "nextpos")
    })
    labels = range(len(unseen["pos"]))
    scores = [F.lit(0.0) for _ in labels]
    for f, name in enumerate([*CONTEXT, "prevpos+pos", "pos+nextpos"]):
        lookup = table.filter(F.col("fname") == name).select(
            F.col("fval").alias(name), *[F.col(f"l{i}").alias(f"_f{f}_{i}") for i in labels]
        )
        rows = rows.join(lookup, name, "left")
        scores = [score + F.coalesce(f"_f{f}_{i}", F.lit(unseen[name][i])) for i, score in enumerate(scores)]
    return rows.select(*CONTEXT, *[score.alias(f"l{i}") for i, score in enumerate(scores)])


def _labels(model: DataFrame, max_labels: int) -> list[str]:
    found = model.select("label").distinct().orderBy("label").limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise ValueError(f"the chunk model has more than {max_labels} labels")
    return [row["label"] for row in found]


def tag_chunks(
    features: DataFrame, model: ChunkModel, words: DataFrame | None = None, rare: DataFrame | None = None
) -> DataFrame:
    """Add ``iob``: the most probable label of each token, ties to the last label.

    The five features made of a tag and its neighbours are scored beforehand for every
    combination of tags, so three lookup joins do: that combination, the tags since the
    last determiner, and the word. Each brings one column per label; a value the model
    has not seen gets the smoothed zero. What is small enough is broadcast, each by
    itself: a large table of words is the only one that shuffles tokens, those of words
    that are not frequent. ``words`` may give the tokens' keys and words from a shorter plan.

    ``rare`` may give the features of the tokens without a frequent word. Then they stay where
    they were shuffled to, in place of bringing what was found back to their sentence: that
    is for tokens that nothing has placed.
    """
    if rare is not None and model.frequent_words() is not None:
        return _labelled(features, model, "frequent").unionByName(_labelled(rare, model, "rare"))
    return _labelled(features, model, "all", words)


def _labelled(
    features: DataFrame, model: ChunkModel, which: str, words: DataFrame | None = None
) -> DataFrame:
    """Tokens of all words, or of only ``frequent`` or ``rare`` ones, with their ``iob``."""
    scored, scores = features, [F.lit(prior) for prior in model.priors]
    names = dict(FEATURES)
    if model.contexts is not None:
        place = {}
        for name, column in CONTEXT.items():
            place[f"_{name}"] = F.when(F.col(column).isin(model.seen[name]), F.col(column)).otherwise(F.lit(UNSEEN))
        lookup = model.contexts.select(
            *[F.col(name).alias(f"_{name}") for name in CONTEXT],
            *[F.col(f"l{i}").alias(f"_c_{i}") for i in range(len(scores))],
        )
        # Every token has its combination in the table, whose size is bounded.
        scored = lookup_join(scored.withColumns(place), lookup, list(place), broadcast=True)
        scores = [score + F.col(f"_c_{i}") for i, score in enumerate(scores)]
        names = {name: names[name] for name in ("word", "tags-since-dt")}
    for f, (name, column) in enumerate(names.items()):
        values = [
            F.col("fval").alias(f"_v{f}"),
            *[F.col(f"l{i}").alias(f"_f{f}_{i}") for i in range(len(scores))],
        ]
        lookup = model.table.filter(F.col("fname") == name).select(*values)
        scored = scored.withColumn(f"_v{f}", F.col(column))
        if name == "word" and which == "frequent":
            scored = scored.join(F.broadcast(model.frequent.select(*values)), f"_v{f}")
        elif name == "word" and which == "rare":
            # The few tokens go to the words; words that only the model has are of no use.
            scored = scored.join(lookup, f"_v{f}", "left")
        elif name == "word" and model.frequent is not None and not model.broadcast["word"]:
            if words is not None:
                words = words.withColumnRenamed("word", f"_v{f}")
            scored = lookup_tokens(scored, lookup, model.frequent.select(*values), f"_v{f}", words)
        else:
            scored = lookup_join(
                scored,
                lookup,
                [f"_v{f}"],
                "left",
                broadcast=model.broadcast.get(name, True),
                spread_by=TOKEN_KEY,
            )
        scores = [
            score + F.coalesce(f"_f{f}_{i}", F.lit(model.unseen[name][i]))
            for i, score in enumerate(scores)
        ]
    keep = [c for c in features.columns if c != "iob"]
    scored = scored.select(*keep, *[score.alias(f"_s{i}") for i, score in enumerate(scores)])
    return scored.select(*keep, best_label([f"_s{i}" for i in range(len(scores))], model.labels).alias("iob"))


# Scores are compared as rounded to so many places.
PLACES = 9


def best_label(scores: Sequence[str], labels: Sequence[str]) -> Column:
    """The label of the column with the highest score; of equal ones the last label.

    Rounding takes longer than all else, so it is left to scores as close as it could move.
    """
    ranked = [
        F.struct(F.round(F.col(score), PLACES).alias("score"), F.lit(label).alias("label"))
        for score, label in zip(scores, labels, strict=True)
    ]
    if len(ranked) == 1:
        return ranked[0]["label"]
    near = F.greatest(*[F.col(s) for s in scores]) - F.lit(3 * 10.0**-PLACES)
    count = reduce(add, [F.when(F.col(s) >= near, 1).otherwise(0) for s in scores])
    clear = F.coalesce(*[F.when(F.col(s) >= near, F.lit(label)) for s, label in zip(scores, labels, strict=True)])
    return F.when(count == 1, clear).otherwise(F.greatest(*ranked)["label"])
