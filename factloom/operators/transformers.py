"""The text steps as ``pyspark.ml`` stages, for use in a ``Pipeline``.

Each stage only wraps the column function of the same step, so a pipeline of them
is one plan of native expressions, and can be saved and loaded.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import chunks as C
from factloom.functions import gazetteer as G
from factloom.functions import text as X
from factloom.functions.binding import let
from factloom.functions.tags import rule_tags
from factloom.operators.relations import capitalised_iob
from factloom.operators.sentences import explode_column


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose keyword arguments are its parameters."""

    def _start(self, **given) -> None:
        self._set(**{name: value for name, value in given.items() if value is not None})


class _ColumnStage(_Stage, HasInputCol, HasOutputCol):
    """Adds one column computed from another."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._start(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.expression(F.col(self.getInputCol())))

    def expression(self, column: Column) -> Column:
        raise NotImplementedError


class SentenceSplitter(_ColumnStage):
    """Text to a list of sentences."""

    def expression(self, column: Column) -> Column:
        return X.split_sentences(column)


class WordPunctTokenizer(_ColumnStage):
    """Sentence to words and runs of punctuation, without the given stop words."""

    stopwords = Param(
        Params._dummy(), "stopwords", "words left out", typeConverter=TypeConverters.toListString
    )

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str | None = None,
        outputCol: str | None = None,
        stopwords: list[str] | None = None,
    ) -> None:
        Transformer.__init__(self)
        self._setDefault(stopwords=[])
        self._start(**self._input_kwargs)

    def setStopwords(self, value: list[str]) -> WordPunctTokenizer:
        return self._set(stopwords=value)

    def getStopwords(self) -> list[str]:
        return self.getOrDefault(self.stopwords)

    def expression(self, column: Column) -> Column:
        return X.tokenize_wordpunct(column, self.getStopwords())


class ListConcatenator(_Stage, HasInputCols, HasOutputCol):
    """Any number of list columns to one list."""

    @keyword_only
    def __init__(
        self, *, inputCols: list[str] | None = None, outputCol: str | None = None
    ) -> None:
        super().__init__()
        self._start(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        lists = [F.col(c) for c in self.getInputCols()]
        return dataset.withColumn(self.getOutputCol(), X.concat_lists(*lists))


class ListExploder(_Stage, HasInputCol, HasOutputCol):
    """One row per element of a list column; all columns are kept."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._start(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return explode_column(dataset, self.getInputCol(), self.getOutputCol())


class ColumnSelector(_Stage, HasOutputCols):
    """Keeps the named columns."""

    @keyword_only
    def __init__(self, *, outputCols: list[str] | None = None) -> None:
        super().__init__()
        self._start(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(*self.getOutputCols())


class TripleExtractor(_ColumnStage):
    """Sentence to ``array<array<string>>`` of subject, filler, object.

    With ``patterns``, a list of [regular expression, tag], the chunks are the
    gazetteer's names; without, they are runs of capitalised words.
    """

    patterns = Param(Params._dummy(), "patterns", "[regular expression, tag] pairs")

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str | None = None,
        outputCol: str | None = None,
        patterns: list | None = None,
    ) -> None:
        Transformer.__init__(self)
        self._setDefault(patterns=[])
        self._start(**self._input_kwargs)

    def expression(self, column: Column) -> Column:
        patterns = [tuple(p) for p in self.getOrDefault(self.patterns)]

        def triples(words: Column) -> Column:
            if patterns:
                labels = let(
                    G.find_phrases(column, patterns), lambda found: G.phrase_iob(words, found)
                )
            else:
                labels = capitalised_iob(words)
            related = C.sentence_relations(words, rule_tags(words), labels)
            return C.as_lists(C.as_triples(related))

        return let(X.tokenize_wordpunct(column), triples)
