"""Licence notices in documents, by a trained paragraph classifier.

Each line of a text is a paragraph. A multinomial logistic regression over the
words, pairs and triples of words that the notice templates have, and over the
number of a line's other words, tells licence families and "unknown" apart. It
is trained here, on the templates with words left out and on half of all corpus
paragraphs as "unknown". The probability that counts as a find is calibrated on
the other half: at most one in a thousand of them may pass, as long as that
probability lies between 0.5 and 0.9. A find is confirmed when the paragraph
holds enough of the words of one of its family's templates.

The texts are read once; what training, calibration and scan need of a
paragraph is a few numbers and is staged. All of it is DataFrame and Spark ML
work. Null and empty texts have no paragraphs. Repeated rows give repeated
finds. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsflow.functions.text import let
from newsflow.operators.staging import Staging, staging_for

# Notices by which licences are announced.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Released under the BSD License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *dict.fromkeys(family for family, _ in TEMPLATES)]
# All "unknown" lines together weigh like so many notices at most, however many there are.
UNKNOWN_WEIGHT = 4000.0
FALSE_FINDS = 0.001
# Thresholds are multiples of 1 / STEPS.
STEPS = 1 << 12
CONFIRMED = 0.6


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with dots and hyphens inside them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def placed(tokens: Column, known: list[str] | None = None) -> Column:
    """(at, word) of the words; of those in ``known`` only, if given."""

    def entry(w: Column, i: Column) -> Column:
        found = F.struct(i.alias("at"), w.alias("word"))
        return found if known is None else F.when(w.isin(known), found)

    return F.array_compact(F.transform(tokens, entry))


def grams(found: Column) -> Column:
    """Words, pairs and triples of neighbouring words, of ``placed`` words."""

    def run(entries: Column, size: int) -> Column:
        def joined(first: Column, i: Column) -> Column:
            parts = [first, *(F.get(entries, i + n) for n in range(1, size))]
            return F.when(parts[-1]["at"] == first["at"] + size - 1, F.concat_ws(" ", *(part["word"] for part in parts)))

        return F.array_compact(F.transform(entries, joined))

    return let(found, lambda entries: F.concat(entries["word"], run(entries, 2), run(entries, 3)))


def paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, paragraph, body): the lines that have words, numbered from 0."""
    lines = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("paragraph", "body"))
    return lines.filter(F.col("body").rlike(r"[\p{L}\p{N}]"))


def notices(spark: SparkSession) -> DataFrame:
    """(label, w): the templates' words, whole and with up to two neighbouring words left out.

    So no single word decides.
    """
    rows = spark.createDataFrame([(float(FAMILIES.index(family)), text) for family, text in TEMPLATES], "label double, body string")
    whole = rows.select("label", words(F.col("body")).alias("w"))
    without = F.transform(
        F.sequence(F.lit(0), F.size("w")),
        lambda at: F.filter(F.transform("w", lambda w, i: F.when((i >= at) & (i < at + 2), F.lit("")).otherwise(w)), lambda w: w != ""),
    )
    return whole.unionByName(whole.select("label", F.explode(without).alias("w"))).filter("size(w) > 2")


def described(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``rows`` with, instead of their words w, known (those that templates have, once each), plain and features.

    Plain are lines that a template's own words do not make up; others are notices themselves, not examples of "unknown".
    """
    known = [gram for gram in vocabulary if " " not in gram]
    found = rows.withColumn("found", placed(F.col("w"), known)).withColumn("grams", grams(F.col("found")))
    found = found.withColumn("known", F.array_distinct(F.col("found")["word"])).withColumn("others", F.log1p(F.size("w") - F.size("found")))
    found = found.withColumn("plain", F.size("known") * 2 < F.size(F.array_distinct("w")))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="counts").setBinary(True).transform(found)
    return VectorAssembler(inputCols=["counts", "others"], outputCol="features").transform(counted).drop("w", "found", "grams", "others", "counts")


def grams_of_notices(spark: SparkSession) -> list[str]:
    """Every word, pair and triple of the templates: what TEMPLATES has, whatever the corpus."""
    rows = notices(spark).select(F.explode(grams(placed(F.col("w")))).alias("gram")).distinct().collect()
    return sorted(row["gram"] for row in rows)


class Scanner:
    """A fitted model, the calibrated probability, and how many corpus lines each came from."""

    def __init__(self, model: LogisticRegressionModel, vocabulary: list[str], threshold: float, trained: int, held: int):
        self.model, self.vocabulary, self.threshold, self.trained, self.held = model, vocabulary, threshold, trained, held


def _lines(docs: DataFrame, doc_id: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(doc_id, paragraph, held, known, plain, features) of all lines; a hash of the line says whether it is held out."""
    lines = paragraphs(docs, doc_id, text)
    held = F.pmod(F.xxhash64("doc_id", "paragraph", "body"), F.lit(2)) == 1
    return described(lines.select("doc_id", "paragraph", held.alias("held"), words(F.col("body")).alias("w")), vocabulary)


def _best(scored: DataFrame) -> DataFrame:
    """With the largest probability of a licence family."""
    return scored.withColumn("probability", F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1)))


def _threshold(held: DataFrame, count: int) -> float:
    """The smallest probability, in steps, that at most FALSE_FINDS of the held-out lines reach.

    The lines are counted by step, so at most STEPS numbers come to the driver.
    """
    steps = held.filter("probability >= 0.5").groupBy(F.floor(F.col("probability") * STEPS).alias("step")).count().collect()
    passed = 0
    for step, lines in sorted(steps, reverse=True):
        passed += lines
        if passed > FALSE_FINDS * count:
            return min(0.9, (step + 1) / STEPS)
    return 0.5


def fit(lines: DataFrame, vocabulary: list[str]) -> Scanner:
    """Train on templates and the lines that are not held out; calibrate on those that are."""
    plain = lines.filter("plain")
    trained, held = plain.agg(F.count_if(~F.col("held")), F.count_if("held")).first()
    own = described(notices(lines.sparkSession), vocabulary).select("label", F.lit(1.0).alias("weight"), "features")
    weight = F.lit(UNKNOWN_WEIGHT / max(trained, UNKNOWN_WEIGHT))
    other = plain.filter(~F.col("held")).select(F.lit(0.0).alias("label"), weight.alias("weight"), "features")
    model = LogisticRegression(maxIter=60, regParam=0.0005, family="multinomial", weightCol="weight").fit(own.unionByName(other))
    return Scanner(model, vocabulary, _threshold(_best(model.transform(plain.filter("held"))), held), trained, held)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scanner: Scanner | None = None, staging: Staging | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, match): confirmed licence notices."""
    staging = staging_for(docs, staging)
    vocabulary = scanner.vocabulary if scanner else grams_of_notices(docs.sparkSession)
    lines = staging.table(_lines(docs, doc_id, text, vocabulary), "lines")
    scanner = scanner or fit(lines, vocabulary)
    found = (
        _best(scanner.model.transform(lines))
        .filter((F.col("probability") >= scanner.threshold) & (F.col("prediction") > 0))
        .withColumn("family", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("prediction").cast("int") + 1))
    )
    share = F.lit(0.0)
    for family, template in TEMPLATES:
        own = F.array_distinct(words(F.lit(template)))
        part = F.size(F.array_intersect(F.col("known"), own)) / F.size(own)
        share = F.greatest(share, F.when(F.col("family") == family, part).otherwise(0.0))
    return found.withColumn("match", share).filter(F.col("match") >= CONFIRMED).select("doc_id", "paragraph", "family", "probability", "match")
