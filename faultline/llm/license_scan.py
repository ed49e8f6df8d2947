"""Licence recognition by known sentences.

A text is cut into sentences, each sentence is normalised and joined to a table of known licence
sentences, and the sequence of sentence ids of a document is matched against licence rules, in the
order of the rule table: a rule that fits takes its sentences out of the sequence, so a general
rule listed later does not report again what a more special one has explained.

Sentences are numbered by pieces, which end at line ends and punctuation. A known sentence may also
run over several pieces up to a blank line (wrapped lines, marks of comments, a version after "v.",
clauses split at a colon); it has the number of its first piece. Of known sentences that overlap,
the one that starts first counts, and of those the longest.

Defined results: one row per input row, repeated ids and rows included. Null and empty texts hold
no sentence. ``licenses`` lists the distinct names in order of first place in the text (rule order
breaks ties); ``first_sentence`` is the number, from 0, of the first known sentence, null if none;
``unexplained`` counts known sentences that no rule took. Columns other than the two read are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import ascii_lower, same, table, text_key

#: Normalised licence sentences (no version numbers, no punctuation) and their ids.
SENTENCES = (
    ("released under the mit license", "mit_notice"),
    ("licensed under the mit license", "mit_notice"),
    ("this software is released under the mit license", "mit_notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit_grant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit_condition"),
    ("the software is provided as is without warranty of any kind express or implied", "mit_warranty"),
    ("licensed under the apache license version N", "apache_notice"),
    ("you may not use this file except in compliance with the license", "apache_compliance"),
    ("you may obtain a copy of the license at", "apache_copy"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache_warranty"),
    ("this work is licensed under the gnu general public license version N", "gpl_version"),
    ("licensed under the gnu general public license version N", "gpl_version"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl_grant"),
    ("either version N of the license or at your option any later version", "or_later"),
    ("this program is distributed in the hope that it will be useful but without any warranty", "gnu_warranty"),
    ("licensed under the gnu lesser general public license version N", "lgpl_version"),
    ("licensed under the gnu affero general public license version N", "agpl_version"),
    ("licensed under cc by N", "cc_by"),
    ("licensed under cc by sa N", "cc_by_sa"),
    ("licensed under cc by nc N", "cc_by_nc"),
    ("licensed under cc by nd N", "cc_by_nd"),
    ("licensed under cc by nc sa N", "cc_by_nc_sa"),
    ("licensed under cc by nc nd N", "cc_by_nc_nd"),
    ("this work is licensed under a creative commons attribution N international license", "cc_by"),
    ("this work is licensed under a creative commons attribution sharealike N international license", "cc_by_sa"),
    ("this work is licensed under a creative commons attribution noncommercial N international license", "cc_by_nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd_grant"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd_source"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd_binary"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("this source code form is subject to the terms of the mozilla public license v N", "mpl_notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all_rights"),
)
#: Fixed values: (licence, sentence ids that must follow one another in this order), special rules first.
RULES = (
    ("GPL-or-later", ("gpl_grant", "or_later")),
    ("GPL-or-later", ("gpl_version", "or_later")),
    ("GPL", ("gpl_grant",)),
    ("GPL", ("gpl_version",)),
    ("LGPL", ("lgpl_version",)),
    ("AGPL", ("agpl_version",)),
    ("Apache", ("apache_notice", "apache_compliance", "apache_copy", "apache_warranty")),
    ("Apache", ("apache_notice", "apache_compliance")),
    ("Apache", ("apache_notice",)),
    ("MIT", ("mit_grant", "mit_condition", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_condition")),
    ("MIT", ("mit_notice",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("CC-BY", ("cc_by",)),
    ("CC-BY-SA", ("cc_by_sa",)),
    ("CC-BY-NC", ("cc_by_nc",)),
    ("CC-BY-ND", ("cc_by_nd",)),
    ("CC-BY-NC-SA", ("cc_by_nc_sa",)),
    ("CC-BY-NC-ND", ("cc_by_nc_nd",)),
    ("MPL", ("mpl_notice",)),
    ("Unlicense", ("unlicense",)),
    ("All-rights-reserved", ("all_rights",)),
)
_LATER = "as published by the free software foundation either version N of the license or at your option any later version"
_GRANT = "is free software you can redistribute it and or modify it under the terms of the gnu"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
#: Sentences of the standard texts and headers, as they run on. SQL knows the tables above alone.
STANDARD_SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit_grant"),
    ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software", "mit_condition"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit_warranty"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement", "mit_warranty"),
    ("licensed under the apache license version N the license", "apache_notice"),
    ("apache license version N january N", "apache_title"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache_warranty"),
    *((f"this {what} {_GRANT} general public license {_LATER}", "gpl_grant_later") for what in ("program", "library", "software", "file")),
    *((f"this {what} {_GRANT} lesser general public license {_LATER}", "lgpl_grant") for what in ("program", "library", "software", "file")),
    *((f"this {what} {_GRANT} library general public license {_LATER}", "lgpl_grant") for what in ("program", "library")),
    *((f"this {what} {_GRANT} affero general public license {_LATER}", "agpl_grant") for what in ("program", "library", "software", "file")),
    (f"this program {_GRANT} general public license as published by the free software foundation version N of the license", "gpl_grant"),
    (f"this program {_GRANT} general public license as published by the free software foundation either version N of the license", "gpl_grant"),
    (f"this program {_GRANT} general public license version N as published by the free software foundation", "gpl_grant"),
    *((f"this {what} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gnu_warranty") for what in ("program", "library", "software", "file")),
    ("gnu general public license version N june N", "gpl_title"),
    ("gnu general public license version N N june N", "gpl_title"),
    ("gnu lesser general public license version N N june N", "lgpl_title"),
    ("gnu lesser general public license version N february N", "lgpl_title"),
    ("gnu affero general public license version N N november N", "agpl_title"),
    ("gnu affero general public license version N november N", "agpl_title"),
    ("mozilla public license version N", "mpl_title"),
    (f"N {_BSD_SOURCE}", "bsd_source"),
    (f"N {_BSD_BINARY}", "bsd_binary"),
    ("N neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
    ("neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd_names"),
)
STANDARD_RULES = (
    ("GPL-or-later", ("gpl_grant_later", "gnu_warranty")),
    ("GPL-or-later", ("gpl_grant_later",)),
    ("GPL", ("gpl_grant", "gnu_warranty")),
    ("GPL", ("gpl_title",)),
    ("LGPL", ("lgpl_grant", "gnu_warranty")),
    ("LGPL", ("lgpl_grant",)),
    ("LGPL", ("lgpl_title",)),
    ("AGPL", ("agpl_grant", "gnu_warranty")),
    ("AGPL", ("agpl_grant",)),
    ("AGPL", ("agpl_title",)),
    ("Apache", ("apache_title",)),
    ("MPL", ("mpl_title",)),
)
ALL_SENTENCES, ALL_RULES = SENTENCES + STANDARD_SENTENCES, STANDARD_RULES + RULES
#: A sentence ends at a line end, or at one of these with white space behind it.
SENTENCE_END = r"\n|[.!?;:][ \t\r]+"
VERSION = r"\b[0-9]+(\.[0-9]+)*\b"
NOT_WORD = r"[^a-zN]+"


def sentence_table(spark: SparkSession, sentences=ALL_SENTENCES) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(s).alias("_sentence"), F.lit(i).alias("_known")) for s, i in sentences))
    return spark.range(1).select(F.inline(rows))


def normalise(sentence: Column) -> Column:
    """Lower case, versions as N, all else but letters as one space."""
    spaced = F.regexp_replace(ascii_lower(sentence), VERSION, " N ")
    return F.trim(F.regexp_replace(spaced, NOT_WORD, " "))


def _apply_rules(sequence: Column, rules) -> Column:
    """Rewrite every run ``at=id; at=id;`` that a rule names to ``at#licence;``, rule by rule."""
    for name, ids in rules:
        pattern = "([0-9]+)=" + " [0-9]+=".join(f"{i};" for i in ids)
        sequence = F.regexp_replace(sequence, pattern, f"$1#{name};")
    return sequence


def _running(normal: DataFrame, sentences: DataFrame, id_column: str) -> DataFrame:
    """(id, _key, _at, _last, _known): known sentences over more than one piece, none of them blank.

    Pieces are joined by a bar and compared word by word. Only places whose first word begins a
    known sentence are tried, and no further than the longest sentence has words.
    """
    known = sentences.withColumn("_begin", F.substring_index("_sentence", " ", 1)).withColumn("_n", F.length("_sentence"))
    # one row: first words and the most words of the fixed table
    bounds = known.agg(F.collect_set("_begin").alias("_begins"), F.max(F.size(F.split("_sentence", " "))).alias("_most"))
    n = F.size("_pieces")
    begins = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.array_contains("_begins", F.substring_index(F.get("_pieces", i), " ", 1)) & (F.coalesce(F.get("_pieces", i + 1), F.lit("")) != ""),
    )
    tails = (
        normal.crossJoin(F.broadcast(bounds))
        .select(id_column, "_key", F.explode(F.transform(begins, lambda i: F.struct(i.alias("at"), F.slice("_pieces", i + 1, F.col("_most")).alias("pieces")))).alias("t"))
        .select(id_column, "_key", F.col("t.at").alias("_at"), F.element_at(F.split(F.array_join("t.pieces", "|"), r"\|\|"), 1).alias("_tail"))
        .withColumn("_words", F.translate("_tail", "|", " "))
        .withColumn("_begin", F.substring_index("_words", " ", 1))
    )
    run = F.substring(F.col("_tail"), F.lit(1), F.col("_n"))
    fits = F.col("_words").startswith(F.col("_sentence")) & F.substring(F.col("_tail"), F.col("_n") + 1, F.lit(1)).isin("", "|")
    return (
        tails.join(F.broadcast(known), "_begin")  # the fixed table
        .where(fits & run.contains("|"))
        .select(id_column, "_key", "_at", (F.col("_at") + F.length(run) - F.length(F.translate(run, "|", ""))).alias("_last"), "_known")
    )


def _apart(found: Column) -> Column:
    """Drop what lies in the pieces of an earlier or longer sentence."""
    start = F.struct(F.lit(-1).alias("last"), F.filter(found, lambda x: F.lit(False)).alias("kept"))
    step = lambda s, x: F.when(
        x["_at"] > s["last"], F.struct((-x["_back"]).alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))
    ).otherwise(s)
    several = F.exists(found, lambda x: x["_at"] != -x["_back"])
    return F.when(several, F.aggregate(found, start, step, lambda s: s["kept"])).otherwise(found)


def scan_licenses(
    documents: DataFrame, sentences: DataFrame, rules=ALL_RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_license_sentences, first_sentence, licenses, unexplained) for every row."""
    rows = documents.select(
        F.col(id_column), text_key(F.col(text_column)).alias("_key"), F.coalesce(F.col(text_column), F.lit("")).alias("_text")
    )
    normal = rows.select(id_column, "_key", F.transform(F.split("_text", SENTENCE_END), normalise).alias("_pieces"))
    single = (
        normal.select(id_column, "_key", F.posexplode("_pieces").alias("_at", "_sentence"))
        .join(sentences, "_sentence")
        .select(id_column, "_key", "_at", F.col("_at").alias("_last"), "_known")
    )
    # a set of (place, last piece, id) is the same however often its row is repeated
    sequences = (
        single.union(_running(normal, sentences, id_column))
        .groupBy(id_column, "_key")
        .agg(F.array_sort(F.collect_set(F.struct("_at", (-F.col("_last")).alias("_back"), "_known"))).alias("_all"))
        .withColumn("_found", _apart(F.col("_all")))
        .select(
            F.col(id_column).alias("_id"),
            F.col("_key").alias("_other"),
            F.size("_found").cast("long").alias("_n"),
            F.col("_found")[0]["_at"].cast("long").alias("_first"),
            _apply_rules(
                F.array_join(F.transform("_found", lambda x: F.concat(x["_at"].cast("string"), F.lit("="), x["_known"], F.lit(";"))), " "),
                rules,
            ).alias("_sequence"),
        )
    )
    meets = F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_other"))
    named = F.array_distinct(F.expr(r"regexp_extract_all(_sequence, '#([^;]+);', 1)"))
    unexplained = F.size(F.expr("regexp_extract_all(_sequence, '=', 0)"))
    return (
        rows.select(id_column, "_key")
        .join(sequences, meets, "left")
        .select(
            id_column,
            F.coalesce("_n", F.lit(0)).cast("long").alias("n_license_sentences"),
            F.col("_first").alias("first_sentence"),
            F.coalesce(F.array_join(named, ","), F.lit("")).alias("licenses"),
            F.when(F.col("_sequence").isNull(), 0).otherwise(unexplained).cast("long").alias("unexplained"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), sentence_table(spark))


def _oracle() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES)
    sequence = "string_agg(place || '=' || id || ';', ' ' ORDER BY place)"
    for name, ids in RULES:
        pattern = "([0-9]+)=" + " [0-9]+=".join(f"{i};" for i in ids)
        sequence = f"regexp_replace({sequence}, '{pattern}', '\\1#{name};', 'g')"
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
doc AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
piece AS (SELECT n, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS place
    FROM (SELECT n, regexp_split_to_array(text, '{SENTENCE_END}') AS p FROM doc)),
found AS (SELECT n, place, id FROM (
    SELECT n, place, trim(regexp_replace(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{VERSION}', ' N ', 'g'), '{NOT_WORD}', ' ', 'g')) AS sentence FROM piece) JOIN known USING (sentence)),
seq AS (SELECT n, count(*) AS k, min(place) AS first_at, {sequence} AS s FROM found GROUP BY n)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_license_sentences, first_at::BIGINT AS first_sentence,
    coalesce((SELECT string_agg(x, ',' ORDER BY i) FROM (
        SELECT x, min(i) AS i FROM (SELECT unnest(r) AS x, generate_subscripts(r, 1) AS i
            FROM (SELECT regexp_extract_all(s, '#([^;]+);', 1) AS r)) GROUP BY x)), '') AS licenses,
    coalesce(len(regexp_extract_all(s, '=')), 0)::BIGINT AS unexplained
FROM doc LEFT JOIN seq USING (n)
"""


ORACLE = _oracle()
