"""Features out of text behind a replaceable provider, cached by what decides the result."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.workers import by_value
from causeway.operators.encoding import FeatureSpec
from causeway.sources.tables import exists

by_value(__name__)

PREFIX = "explicit_feat_"


class Provider(Protocol):
    """Makes, in a worker, a function from texts to answers; each answer should hold a flat JSON object."""

    name: str

    def client(self) -> Callable[[list[str]], list[str]]: ...


class KeywordProvider:
    """Offline default: a category that stands in the text, or the number behind the feature's name."""

    name = "keyword-1"

    def __init__(self, specs: list[FeatureSpec]):
        self.specs = specs

    def client(self) -> Callable[[list[str]], list[str]]:
        import re

        def answer(text: str) -> str:
            out = {}
            for s in self.specs:
                label = s.name.replace("_", " ")
                if s.kind == "continuous":
                    m = re.search(rf"\b{re.escape(label)}\b\D{{0,20}}(-?\d+(?:\.\d+)?)", text, re.I)
                    out[s.name] = float(m[1]) if m else None
                else:
                    out[s.name] = next((c for c in s.categories if re.search(rf"\b{re.escape(label)}\b.{{0,20}}\b{re.escape(c)}\b", text, re.I)), None)
            return json.dumps(out)

        return lambda texts: [answer(t) for t in texts]


def parse(response: str | None, specs: list[FeatureSpec]) -> dict[str, str | float | None]:
    """Typed values of the first flat {...}: categories exactly, then in any case; numbers as floats; None for what is missing or doesn't fit."""
    import math
    import re

    found = re.search(r"\{[^{}]*\}", response or "")
    try:
        raw = json.loads(found[0]) if found else {}
    except ValueError:
        raw = {}
    out: dict[str, str | float | None] = {}
    for s in specs:
        v = raw.get(s.name)
        if s.kind == "continuous":
            try:
                x = float(v)
                out[s.name] = x if math.isfinite(x) else None
            except (TypeError, ValueError):
                out[s.name] = None
        else:
            text = "" if v is None else str(v).strip()
            out[s.name] = text if text in s.categories else next((c for c in s.categories if c.lower() == text.lower()), None)
    return out


def extract(df: DataFrame, text: str, specs: list[FeatureSpec], provider: Provider, retries: int = 3, prefix: str = PREFIX) -> DataFrame:
    """df with a value column and a missing flag for each spec. An incomplete answer is asked again; the one with fewest missing values is kept."""
    fields = [f for s in specs for f in (T.StructField(prefix + s.name, T.DoubleType() if s.kind == "continuous" else T.StringType()), T.StructField(f"{prefix}{s.name}_missing", T.BooleanType()))]
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider.client()
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            best: list[dict] = [{s.name: None for s in specs} for _ in texts]
            todo = list(range(len(texts)))
            for _ in range(retries):
                if not todo:
                    break
                for i, answer in zip(todo, ask([texts[i] for i in todo]), strict=True):
                    got = parse(answer, specs)
                    if sum(v is None for v in got.values()) < sum(v is None for v in best[i].values()):
                        best[i] = got
                todo = [i for i in todo if None in best[i].values()]
            out = pdf.copy()
            for s in specs:
                values = [b[s.name] for b in best]
                out[prefix + s.name] = pd.Series(values, index=pdf.index, dtype="float64" if s.kind == "continuous" else "object")
                out[f"{prefix}{s.name}_missing"] = [v is None for v in values]
            yield out

    return df.mapInPandas(run, schema)


def extract_in_turn(df: DataFrame, key: str, servers: int, text: str, specs: list[FeatureSpec], provider: Provider, **how) -> DataFrame:
    """extract() by as many tasks as there are servers, rows dealt to them in turn by their number `key`, which tells their order afterwards too."""
    return extract(df.repartitionById(servers, F.pmod(F.col(key), F.lit(servers)).cast("int")), text, specs, provider, **how)


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows that an earlier, broken run has not written yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def cache_key(dataset: str, specs: list[FeatureSpec], provider: str, **limits) -> str:
    """Twelve digits of the dataset's and twelve of the configuration's md5."""
    config = json.dumps({"specs": [[s.name, s.kind, list(s.categories), list(s.roles), s.description] for s in specs], "provider": provider, **limits}, sort_keys=True)
    return "_".join(hashlib.md5(x.encode()).hexdigest()[:12] for x in (dataset, config))


def cached_extract(spark: SparkSession, folder: str, dataset: str, df: DataFrame, text: str, specs: list[FeatureSpec], provider: Provider, rows: int | None = None) -> DataFrame:
    """extract(), or what an earlier run wrote under the same key if its rows and columns fit. The row count is part of the key."""
    n = df.count() if rows is None else rows
    path = f"{folder.rstrip('/')}/{cache_key(f'{dataset}#{n}', specs, provider.name)}"
    wanted = {PREFIX + s.name + x for s in specs for x in ("", "_missing")}
    if exists(spark, f"{path}/_SUCCESS"):  # the writer's mark: a run that broke off left none
        old = spark.read.parquet(path)
        if wanted <= set(old.columns) and old.count() == n:
            return old
    extract(df, text, specs, provider).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
