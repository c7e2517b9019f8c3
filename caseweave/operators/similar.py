"""Events of a document that say the same: a fold that keeps the better of similar ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from caseweave.functions.text import SPACE

#: Words over this share in common (of either's) make two events of a date the same (fixed value).
ALIKE = 0.6


def plain_words(text: Column) -> Column:
    """The distinct words of more than 3 characters, in lower case, after all but letters, digits, underscores, spaces and àèéìòù is taken out."""
    kept = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_àèéìòù" + SPACE[1:], "")
    return F.array_distinct(F.filter(F.split(kept, SPACE + "+"), lambda w: F.length(w) > 3))


class Slots:
    """The kept events of one document and date, in the order in which their slots were opened.

    Words point to the slots that have them, so a new event is only compared with slots that share a word of it.
    """

    def __init__(self) -> None:
        self.kept: list[tuple[frozenset, float, object]] = []
        self.having: dict[str, set[int]] = {}

    def _first_alike(self, words: frozenset) -> int | None:
        if not words:
            return next((k for k, (w, _, _) in enumerate(self.kept) if not w), None)
        shared: dict[int, int] = {}
        for word in words:
            for k in self.having.get(word, ()):
                shared[k] = shared.get(k, 0) + 1
        return min((k for k, n in shared.items() if n / (len(words) + len(self.kept[k][0]) - n) > ALIKE), default=None)

    def add(self, words: frozenset, score: float, event: object) -> None:
        """Open a slot, or take that of the first similar event if the score is higher than its."""
        at = self._first_alike(words)
        if at is None:
            at = len(self.kept)
            self.kept.append((words, score, event))
        elif score > self.kept[at][1]:
            for word in self.kept[at][0]:
                self.having[word].discard(at)
            self.kept[at] = (words, score, event)
        else:
            return
        for word in words:
            self.having.setdefault(word, set()).add(at)


def kept_similar_events(events: DataFrame, document: list[str], date: str, order: str, title: str = "title", description: str = "description", confidence: str = "confidence") -> DataFrame:
    """The events that are left of each document (columns `document`), with all their columns and `slot` (from 0, in order of opening within a date).

    Events go in the order of `order`, a column unique in a document. An event takes part with the first kept one of its date whose words are over
    0.6 similar (two without words are): the better stays in that slot, by ten times the confidence and the length of the
    description, the earlier of equals. A replaced event is compared no more. Null dates are one date, null texts
    empty, a null confidence 0. Rows are dealt by document and date and pass a task one by one; it holds the kept
    events of one date of one document.
    """
    text = F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(description), F.lit("")))
    score = 10 * F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)) + F.length(F.coalesce(F.col(description), F.lit("")))
    when = F.coalesce(F.col(date).cast("string"), F.lit(""))
    name = F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in document), when))
    columns = events.columns
    ready = events.select(F.struct(*columns).alias("row"), plain_words(text).alias("words"), score.alias("score"), name.alias("name"), F.col(order).alias("order"))
    kind = ready.select("row.*").schema
    spark = events.sparkSession

    def fold(batches):
        name, slots = None, Slots()
        for batch in batches:
            given, done = batch.column("row"), []
            for k, (n, words, s) in enumerate(zip(batch.column("name").to_pylist(), batch.column("words").to_pylist(), batch.column("score").to_pylist(), strict=True)):
                if n != name:
                    done += enumerate(e for _, _, e in slots.kept)
                    name, slots = n, Slots()
                slots.add(frozenset(words), s, given.slice(k, 1))
            if done:
                yield out(done)
        if slots.kept:
            yield out(list(enumerate(e for _, _, e in slots.kept)))

    def out(done: list):
        import pyarrow as pa

        rows = pa.concat_arrays([e for _, e in done])
        return pa.RecordBatch.from_arrays([*rows.flatten(), pa.array([k for k, _ in done], pa.int32())], names=[*columns, "slot"])

    dealt = ready.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").sortWithinPartitions("name", "order")
    return dealt.drop("order").mapInArrow(fold, StructType([*kind.fields, StructField("slot", IntegerType())]))
