"""License scans by diagonal voting.

Texts and templates become words; every run of ``K`` words is hashed. All of a
text's hashes are joined, by Spark, to the template positions with that hash. A
match at text word p and template word q votes for the diagonal p - q. Votes are
counted by (text, template, diagonal), diagonals close to each other are merged
(insertions and deletions; a tenth of the template's words apart, ``NEAR`` at least), and a
merged span is verified by the template's words: the share of them that stand in the span
in voted positions, times the share of these positions that come in the template's order (the longest
rising run of template places by text place), must reach the template's least share, and the words that tell it from
its kin (``must``) have to be among them. A place counts once, however often it votes. The
short exact phrases of the base are templates like the others: a phrase stands at p
exactly if all its words stand on one diagonal. Two different runs of words have one
64-bit hash with probability 2^-64; every template of several positions would need several of them.

The templates are a fixed list (or a parameter of checked size), so that side of
the join is broadcast. One text's votes are at most its word count.

Edge cases: null counts as empty; texts with fewer than ``K`` words have no hit;
repeated rows and rows with a null id keep a row each; several places of one phrase all count;
an empty table gives no rows; other columns do not matter. Rows are told apart by their partition
and place in it, so a table whose rows come in another order when they are read again (a shuffle's output) is to be stored first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, grams, plain_words, short_batches

K = 3
NEAR = 2
#: More template words than this are refused: the template side is broadcast.
MOST_WORDS = 200_000
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# License lines, and the notices and texts as their stewards publish them.
LINES = [
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]
NOTICES = [
    (
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "to deal in the software without restriction",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "with or without fee is hereby granted",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties "
        "or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law or agreed to in writing",
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 "
        "of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 2 of the license",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 "
        "of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 3 of the license",
    ),
    (
        "lgpl-2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either "
        "version 2 1 of the license or at your option any later version",
        "gnu lesser general public license as published by the free software foundation either version 2 1",
    ),
    (
        "lgpl-3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version",
        "gnu lesser general public license as published by the free software foundation either version 3 of the license",
    ),
    (
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version",
        "gnu affero general public license",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        "the terms of the mozilla public license",
    ),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use "
        "reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "any person or organization obtaining a copy of the software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "in no event will the authors be held liable",
    ),
    (
        "cc0",
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
        "all copyright and related and neighboring rights",
    ),
    ("mit", "spdx license identifier mit", ""),
    ("apache-2", "spdx license identifier apache 2 0", ""),
    ("bsd", "spdx license identifier bsd", ""),
    ("gpl-2", "spdx license identifier gpl 2 0", ""),
    ("gpl-3", "spdx license identifier gpl 3 0", ""),
    ("lgpl-2.1", "spdx license identifier lgpl 2 1", ""),
    ("lgpl-3", "spdx license identifier lgpl 3 0", ""),
    ("agpl-3", "spdx license identifier agpl 3 0", ""),
    ("mpl-2", "spdx license identifier mpl 2 0", ""),
]


def least_of(words: int) -> float:
    """Share of a template's words that must stand: all of a short line, less of a long text."""
    return 1.0 if words < 7 else 0.8 if words < 40 else 0.6


#: Templates of the method: (label, text, least share of words, words that must stand).
TEMPLATES = [(label, text, least_of(len(text.split())), must) for label, text, must in [*[(label, text, "") for label, text in LINES], *NOTICES]]

_HASHES = WordHashes()


def _signed(h: np.ndarray) -> np.ndarray:
    """Non-zero signed 64-bit hashes; 0 is kept for the row that every text has."""
    h = h.astype(np.int64)
    h[h == 0] = 1
    return h


def must_positions(words: list[bytes], must: list[bytes]) -> list[int]:
    """Template positions of the runs of K words inside ``must``."""
    if not must:
        return []
    at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
    return list(range(at, at + len(must) - K + 1))


def template_positions(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(hash, template, label, base, words, least, must, tpos); the hash 0 stands for the text itself."""
    items = [(label, text, 1.0, "", True) for text, label in phrases] + [(*t, False) for t in templates]
    rows = [(0, -1, "", False, 1, 1.0, [], 0)]
    for t, (label, text, least, must, base) in enumerate(items):
        words = plain_words(text)
        h = _signed(grams(_HASHES.of(words), K))
        if len(h) == 0:
            raise ValueError(f"a template needs {K} words at least: {text!r}")
        needed = must_positions(words, plain_words(must))
        rows += [(int(x), t, label, base, len(words), float(least), needed, i) for i, x in enumerate(h)]
    if len(rows) > MOST_WORDS:
        raise ValueError("too many template words to broadcast")
    return spark.createDataFrame(rows, "hash long, template int, label string, base boolean, words int, least double, must array<int>, tpos int")


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_words, hashes): hashes[0] is 0, then one per run of K words."""
    short_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches):
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            n, hashes = [], []
            for t in b.column(1).to_pylist():
                words = plain_words(t)
                n.append(len(words))
                hashes.append(np.concatenate([np.zeros(1, np.int64), _signed(grams(_HASHES.of(words), K))]))
            ends = np.cumsum([0] + [len(x) for x in hashes])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hashes)) if hashes else pa.array([], pa.int64()))
            rows = pa.array(np.arange(at, at + b.num_rows))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column(0), pa.array(n, pa.int64()), lists], names=["row", "id", "n_words", "hashes"])

    return df.select(id_col, text_col).mapInArrow(work, f"row long, id {kind}, n_words long, hashes array<long>")


def _places() -> Column:
    """(place in the text, minus the place in the template) of a diagonal's votes: of several at one place the last in the template sorts first."""
    return F.transform("voted", lambda t: F.struct((F.col("diagonal") + t).alias("at"), (-t).alias("back")))


def longest_rise(values: Column) -> Column:
    """Length of the longest strictly rising subsequence: ``tails`` holds the least end of those of each length."""
    step = lambda tails, x: F.concat(F.filter(tails, lambda t: t < x), F.array(x), F.slice(F.filter(tails, lambda t: t >= x), 2, 1 << 30))
    return F.size(F.aggregate(values, F.array().cast("array<int>"), step))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row for each row of ``df``: id, n_words, the base's counts and places, labels, score, spans."""
    spark = df.sparkSession
    places = F.broadcast(template_positions(spark, phrases, templates))
    hits = hashed(df, id_col, text_col).select("row", "id", "n_words", F.posexplode("hashes").alias("pos", "hash")).join(places, "hash")
    kind = ["template", "label", "base", "words", "least", "must"]
    diagonal = hits.groupBy("row", "id", "n_words", *kind, (F.col("pos") - 1 - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("voted"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    diagonal = diagonal.withColumn("places", _places())
    # Neighbouring diagonals of one text and template merge; base phrases stay apart.
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = F.greatest(F.lit(NEAR), F.floor(F.col("words") / 10))
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > near, F.lit(True)) | F.col("base")
    merged = (
        diagonal.withColumn("__run", F.sum(far.cast("int")).over(by))
        .groupBy("row", "id", "n_words", *kind, "__run")
        .agg(F.array_distinct(F.flatten(F.collect_list("voted"))).alias("voted"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    )
    standing = F.size(F.array_distinct(F.flatten(F.transform("voted", lambda p: F.sequence(p, p + K - 1)))))
    real = F.col("template") >= 0
    order = longest_rise(F.transform("places", lambda x: -x["back"])) / F.size("voted")
    merged = merged.withColumn("share", F.when(real, standing / F.col("words") * order).otherwise(0.0))
    merged = merged.withColumn("ok", real & (F.col("share") >= F.col("least")) & (F.size(F.array_except("must", "voted")) == 0))
    base, found = F.col("base") & F.col("ok"), F.col("ok")
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    span = F.struct((F.col("low") - 1).alias("first_word"), (F.col("high") - 1 + K).alias("end_word"), "label", "share")
    return (
        merged.groupBy("row", "id", "n_words")
        .agg(
            F.sum(base.cast("long")).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(found).alias("labels"),
            F.max("share").alias("score"),
            F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
        )
        .drop("row")
        .withColumnRenamed("id", id_col)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    values = lambda rows: ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)
    joined = lambda text: " ".join(w.decode() for w in plain_words(text))
    items = [(i, label, joined(text), 1.0, [], True) for i, (text, label) in enumerate(PHRASES)]
    items += [(len(PHRASES) + i, label, joined(text), least, must_positions(plain_words(text), plain_words(must)), False) for i, (label, text, least, must) in enumerate(TEMPLATES)]
    return rf"""
WITH t(template, label, body, least, must, base) AS (VALUES {values(items)}),
tw AS (SELECT template, label, least, must, base, string_split(body, ' ') AS words FROM t),
tg AS (SELECT template, label, least, must, base, len(words) AS size, unnest(range(len(words) - 2)) AS tpos,
         unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM tw),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT rid, unnest(range(greatest(0, len(words) - 2))) AS pos,
        unnest(list_transform(range(1, greatest(1, len(words) - 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram FROM d),
v AS (SELECT rid, template, label, least, must, base, size, pos - tpos AS diagonal, list(DISTINCT tpos) AS voted
      FROM g JOIN tg USING (gram) GROUP BY ALL),
n AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER q > greatest({NEAR}, size // 10), true) THEN 1 ELSE 0 END AS far
      FROM v WINDOW q AS (PARTITION BY rid, template ORDER BY diagonal)),
r AS (SELECT *, sum(far) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM n),
c AS (SELECT rid, template, label, least, must, base, size, run, min(diagonal) AS diagonal, flatten(list(voted)) AS voted,
        list_sort(flatten(list(list_transform(voted, lambda p: {{'place': diagonal + p, 'back': -p}})))) AS places
      FROM r GROUP BY rid, template, label, least, must, base, size, run),
s AS (SELECT *, len(list_distinct(flatten(list_transform(voted, lambda p: [p, p + 1, p + 2]))))::DOUBLE / size
        * (len(list_reduce(list_prepend([]::BIGINT[], list_transform(places, lambda x: [-x.back])), lambda a, b: list_filter(a, lambda t: t < b[1]) || b || list_filter(a, lambda t: t >= b[1])[2:])) / len(list_distinct(voted))) AS reached FROM c),
m AS (SELECT rid, base, label, diagonal, reached AS share, CASE WHEN list_has_all(voted, must) THEN least ELSE 2 END AS least FROM s),
a AS (SELECT rid, count(*) FILTER (base AND share >= least) AS n_base,
        min(diagonal) FILTER (base AND share >= least) AS first_word, max(diagonal) FILTER (base AND share >= least) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share >= least) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= least) AS labels, max(share) AS score FROM m GROUP BY rid)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a ON a.rid = d.rid
"""


SQL = _sql()
