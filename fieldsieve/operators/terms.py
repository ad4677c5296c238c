"""Which of very many terms stand in each text, in one pass over the texts.

All terms of a request, and the terms whose presence excludes a text, go into one Aho-Corasick automaton,
which is sent to each executor once: its size is that of the request. A text is walked once, however many
terms there are, and equal texts of a batch once together. Upper and lower case are levelled by Spark on
both sides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The most rows and bytes of a batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def automaton(words: list[str]) -> Any:
    """Finds words, naming each by its place in the list."""
    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(word, i)
    if words:
        found.make_automaton()
    return found


def term_hits(terms: DataFrame, texts: DataFrame, excluded: Iterable[str] = (), excluding: Iterable[str] = ()) -> DataFrame:
    """(view, uuid, channel, term) for each text (uuid, channel, value) and each different term (view, channel, term) of its channel that it holds.

    A text of a channel in ``excluding`` that holds an ``excluded`` term is found by none. Case does not
    count, blank terms and null texts are never found, and each row of texts counts.
    """
    spark, low = texts.sparkSession, F.lower("term").alias("term")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # whole texts: a task's Python holds one batch of them
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    asked = [tuple(r) for r in terms.select("view", "channel", low).filter(F.trim("term") != "").distinct().collect()]  # a request: what a user writes
    out = sorted({t for t in excluded if t.strip()})
    barred = {r.term for r in spark.createDataFrame([(t,) for t in out], "term string").select(low).collect()} if out else set()
    words = sorted({t for _, _, t in asked} | barred)
    place = {w: i for i, w in enumerate(words)}
    wanted: dict[tuple[str, int], list[str]] = {}
    for view, channel, term in asked:
        wanted.setdefault((channel, place[term]), []).append(view)
    sent = spark.sparkContext.broadcast((automaton(words), words, wanted, {place[t] for t in barred}, set(excluding)))
    kind = texts.schema["uuid"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, words, wanted, barred, excluding = sent.value
        for batch in batches:
            values, channels = batch.column("value").dictionary_encode(), batch.column("channel").dictionary_encode()
            held: dict[int, set[int]] = {}
            pair = channels.indices.to_numpy().astype(np.int64) * max(len(values.dictionary), 1) + values.indices.to_numpy()
            distinct, back = np.unique(pair, return_inverse=True)
            views, found, n = [], [], np.zeros(len(distinct), np.int64)
            for k, code in enumerate(distinct.tolist()):
                channel, value = channels.dictionary[code // len(values.dictionary)].as_py(), code % len(values.dictionary)
                if value not in held:
                    held[value] = {i for _, i in finder.iter(values.dictionary[value].as_py())}
                if channel in excluding and held[value] & barred:
                    continue
                for i in sorted(held[value]):
                    for view in wanted.get((channel, i), ()):
                        views.append(view)
                        found.append(words[i])
                        n[k] += 1
            start = np.cumsum(n) - n
            rows = np.repeat(np.arange(len(back)), n[back])
            at = start[back[rows]] + np.arange(len(rows)) - np.repeat(np.cumsum(n[back]) - n[back], n[back])
            yield pa.RecordBatch.from_arrays(
                [pa.array(views, pa.string()).take(pa.array(at)), batch.column("uuid").take(pa.array(rows)), batch.column("channel").take(pa.array(rows)), pa.array(found, pa.string()).take(pa.array(at))], names=["view", "uuid", "channel", "term"]
            )

    named = sorted({c for _, c, _ in asked})
    if not named:
        return spark.createDataFrame([], f"view string, uuid {kind}, channel string, term string")
    rows = texts.filter(F.col("channel").isin(*named) & F.col("value").isNotNull()).select("uuid", "channel", F.lower("value").alias("value"))
    return rows.mapInArrow(find, f"view string, uuid {kind}, channel string, term string")
