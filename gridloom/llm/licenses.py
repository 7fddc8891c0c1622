"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs of 0-9 and a-z (A-Z lower-cased). A template's 5-word shingles are cut into units of up to UNIT shingles;
a text's shingles are covered by windows of SPAN shingles, one every HOP, so that each run of UNIT shingles lies whole in
the window that has its first shingle among its first HOP. Windows and units have one minimum per band (BANDS of one row
each, the hash XORed with the band's constant). A unit that shares n shingles with a window is at least n / 16 similar to it
(SPAN + UNIT - 1 is 16), so all bands miss it with a probability of at most (15 / 16) ** (16 * n) = 0.356 ** n.
Bands only nominate documents: all shingles of a nominated document are then joined with all shingles of the templates, and a
text holds a template if at least ``percent`` per cent of the template's distinct shingles are found in it. A text at the
threshold that shares SURE shingles or more with a template stays unnominated with a probability below 1e-6, however edits cut
the units. Templates whose threshold is lower are looked up by each of their shingles instead, which misses none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, columns, scratch

WORDS, UNIT, SPAN, HOP, BANDS, SURE = 5, 5, 12, 8, 16, 14
#: Most rows of template keys or shingles, or of nominated ids, that are sent to all tasks (16 bytes each); beyond it they are
#: joined by shuffle.
SENT = 500_000

#: Notices of public licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column whose value is worked out once a row (a projection could be merged into the lambdas that use it)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_words(df: DataFrame, words: int = WORDS) -> DataFrame:
    """df (with text) and w: 64-bit hashes of its words in order; rows with fewer words than a shingle has go."""
    df = _once(df, "w", F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), "[^0-9a-z]+"), ""))
    return _once(df.where(F.size("w") >= words).drop("text"), "wh", F.transform("w", lambda x: F.xxhash64(x))).drop("w")


def _shingle(words: str, at: int) -> Column:
    """The shingle that starts at word ``at``; null if the words end before it does."""
    parts = [F.get(words, F.lit(at + k)) for k in range(WORDS)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts))


def _minima(members: list[Column]) -> Column:
    """One minimum per band over the member hashes (nulls are passed over)."""
    salts = [(0x9E3779B97F4A7C15 * (2 * b + 1)) & ((1 << 64) - 1) for b in range(BANDS)]
    signed = [s - (1 << 64) if s >= 1 << 63 else s for s in salts]
    return F.array(*(F.least(*(m.bitwiseXOR(F.lit(s).cast("long")) for m in members)) for s in signed))


def template_units(templates: DataFrame) -> DataFrame:
    """license_id, total (distinct shingles), unit (its shingles); templates: license_id, text."""
    held = with_words(templates)
    every = F.transform(F.sequence(F.lit(0), F.size("wh") - WORDS), lambda i: F.xxhash64(*(F.get("wh", i + k) for k in range(WORDS))))
    held = _once(held, "h", every).withColumn("total", F.size(F.array_distinct("h")).cast("long"))
    last = F.greatest(F.size("h") - UNIT, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(UNIT)), F.array(last)))
    return held.select("license_id", "total", F.explode(F.transform(starts, lambda s: F.slice("h", s + 1, F.lit(UNIT)))).alias("unit"))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def _windows(texts: DataFrame) -> DataFrame:
    """doc_id and the SPAN shingles h0, h1, ... of each window; null past the end of the text."""
    starts = F.sequence(F.lit(0), F.size("wh") - WORDS, F.lit(HOP))
    window = with_words(texts).select("doc_id", F.explode(F.transform(starts, lambda s: F.slice("wh", s + 1, F.lit(SPAN + WORDS - 1)))).alias("near"))
    return window.select("doc_id", *(_shingle("near", k).alias(f"h{k}") for k in range(SPAN)))


def scan_licenses(docs: DataFrame, templates: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: doc_id, license_id, n_matched, n_template (distinct shingles).

    templates: license_id, text; those of fewer than five words can't be found and are passed over, as are null ones. Null,
    empty and shorter texts hold none. Rows that repeat an id are scanned as one document. Empty table: no rows.
    """
    texts = columns(docs, id_col, text_col).toDF("doc_id", "text")
    units = template_units(templates.select("license_id", "text").where("text is not null and license_id is not null"))
    bands = _minima([F.get("unit", F.lit(k)) for k in range(UNIT)])
    direct = F.col("total") * percent <= 100 * (SURE - 1)
    keyed = _sent(units.select(F.explode(F.when(direct, F.col("unit")).otherwise(bands)).alias("key")).distinct())
    own = [F.col(f"h{k}") for k in range(SPAN)]
    probe = _windows(texts).select("doc_id", F.explode(F.concat(_minima(own), F.array(*own[:HOP]))).alias("key"))
    nominated = scratch(probe.join(keyed, "key", "left_semi").select(F.col("doc_id").alias("nominee")).distinct(), "license-nominees")
    held = texts.join(_sent(nominated), F.col("doc_id").eqNullSafe(F.col("nominee")), "left_semi")
    shingles = _windows(held).select("doc_id", F.explode(F.array(*own[:HOP])).alias("shingle"))
    of = _sent(units.select("license_id", "total", F.explode("unit").alias("shingle")).distinct())
    found = shingles.join(of, "shingle").groupBy("doc_id", "license_id", "total", "shingle").agg(F.lit(1).alias("one"))
    return (
        found.groupBy("doc_id", "license_id", F.col("total").alias("n_template"))
        .agg(F.count("*").alias("n_matched"))
        .where(F.col("n_matched") * 100 >= F.lit(percent) * F.col("n_template"))
        .select("doc_id", "license_id", "n_matched", "n_template")
    )


def template_table(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in TEMPLATES.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.license_id", "t.text")
