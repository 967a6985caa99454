"""Ingest: scan, tokenise, pack into token shards, write them and their manifest."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import npytok, ranges, scans
from . import manifests, packing

#: Encoders of this worker process, by what their factories are made of.
_ENCODERS: dict[bytes, Callable[[list[str]], list[list[int]]]] = {}


def word_encoder() -> Callable[[list[str]], list[list[int]]]:
    """Ids of white-space words from their MD5; needs no vocabulary."""
    import re

    ids: dict[str, int] = {}

    def encode(texts: list[str]) -> list[list[int]]:
        if len(ids) > 1_000_000:
            ids.clear()
        out = []
        for text in texts:
            words = re.split(r"\s+", text)
            for w in set(words).difference(ids):
                ids[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
            out.append([ids[w] for w in words])
        return out

    return encode


def identity(factory: Callable[[], Callable], name: str) -> bytes:
    """A digest of a factory with all that it closes over, and of the name: two lambdas, or functions of one name, differ."""
    return hashlib.sha256(cloudpickle.dumps((factory, name))).digest()


def worker_encoder(factory: Callable[[], Callable], key: bytes) -> Callable[[list[str]], list[list[int]]]:
    """One encoder for each worker process and identity, made when first asked for."""
    if key not in _ENCODERS:
        _ENCODERS[key] = factory()
    return _ENCODERS[key]


def tokenise(rows: DataFrame, factory: Callable[[], Callable] = word_encoder, name: str = "", text: str = "text") -> DataFrame:
    """rows with ``tokens`` in place of their text, encoded in Arrow batches."""
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in kept]
    key = identity(factory, name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = worker_encoder(factory, key)
        for pdf in batches:
            yield pdf[names].assign(tokens=[np.asarray(t, np.int64) for t in encode(list(pdf[text]))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", tokens array<bigint>"
    return rows.mapInPandas(run, schema)


def shard_slices(rows: DataFrame, shard_tokens: int, eos: int = 0, tail: bool = False, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(source, shard, ord, tokens): each source's stream, an end mark after each text, cut into shards.

    A text that crosses a bound is cut there. The unfilled last shard goes unless ``tail``.
    """
    placed = packing.token_offsets(rows, ["source"], list(order))
    first, last = F.floor(F.col("start") / shard_tokens), F.floor((F.col("end") - 1) / shard_tokens)
    each = placed.select("source", "start", "n", F.concat("tokens", F.array(F.lit(eos).cast("long"))).alias("tokens"), F.explode(F.sequence(first, last)).alias("shard"))
    low = F.greatest(F.col("shard") * shard_tokens - F.col("start"), F.lit(0))
    high = F.least((F.col("shard") + 1) * shard_tokens - F.col("start"), F.col("n"))
    cut = each.select("source", "shard", (F.col("start") + low).alias("ord"), F.slice("tokens", (low + 1).cast("int"), (high - low).cast("int")).alias("tokens"))
    if tail:
        return cut
    full = rows.groupBy("source").agg(F.floor(F.sum(F.size("tokens") + 1) / shard_tokens).alias("_full"))
    return cut.join(full, "source").where(F.col("shard") < F.col("_full")).drop("_full")


@dataclass(frozen=True)
class Plan:
    """What an ingest takes and how it names and cuts it.

    prefixes and langs (as prefixes ``data/<lang>/``) choose sources by the beginning of
    their name; files lists sources, which then come in this order. one_shard_per_source
    writes each source's whole stream as one shard; ordered_part takes all of them as one
    stream in the order of the list, or of their names, whose remainders go on from source
    to source. A part of a distributed run has a manifest of its own below ``parts``;
    part_manifest_only leaves out the one of the folder.
    """

    shard_tokens: int = 536_870_912
    text_column: str = "text"
    tokens_column: str = ""
    tokenizer: str = ""
    dataset: str = ""
    version: str = "v3"
    prefixes: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    files: tuple[str, ...] | None = None
    one_shard_per_source: bool = False
    ordered_part: bool = False
    keep_tail: bool = False
    part_id: str = ""
    run_id: str = ""
    part_manifest_only: bool = False
    dry_run: bool = False

    def check(self) -> None:
        if self.shard_tokens < 1:
            raise ValueError("a shard holds one token at least")
        if self.one_shard_per_source and self.ordered_part:
            raise ValueError("one shard for each source, or one stream over all of them")
        if (self.part_manifest_only or self.run_id) and not self.part_id:
            raise ValueError("a part's manifest needs its part_id")

    def mode(self) -> str:
        return "one_npy_per_parquet" if self.one_shard_per_source else "ordered_packed_part" if self.ordered_part else "packed"

    def manifest(self) -> str:
        """Where the part's manifest goes, or the only one."""
        if not self.part_id:
            return npytok.MANIFEST
        return "/".join(filter(None, ("parts", self.run_id, self.part_id, npytok.MANIFEST)))

    def document(self) -> dict:
        made = {"version": self.version, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "tokenizer": self.tokenizer, "source": self.dataset, "tokenization_mode": self.mode()}
        return made | {k: v for k, v in (("distributed_run_id", self.run_id), ("part_id", self.part_id)) if v}


def chosen(texts: DataFrame, plan: Plan) -> DataFrame:
    """Rows of the sources that the plan takes, with ``_place``, their source's place in its list."""
    begins = [*plan.prefixes, *[f"data/{lang}/" for lang in plan.langs]]
    if begins:
        texts = texts.where(reduce(or_, [F.startswith("source", F.lit(b)) for b in begins]))
    if plan.files is not None:
        listed = texts.sparkSession.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(plan.files))], "source string, _place long")
        return texts.join(listed, "source")
    if not plan.ordered_part:
        return texts.withColumn("_place", F.lit(0).cast("long"))
    names = texts.select("source").distinct().withColumn("_place", (F.row_number().over(W.orderBy("source")) - 1).cast("long"))  # a row for each source
    return texts.join(names, "source")


def ingest(spark: SparkSession, texts: DataFrame, folder: str, plan: Plan, encoder: Callable[[], Callable] = word_encoder, completed: DataFrame | None = None) -> DataFrame:
    """Shards of texts (source, ord, text or tokens) below ``folder``, and their manifest rows.

    completed: sources (source) that an earlier run finished, which are left out. A dry
    run gives the manifest rows that would come, without writing.
    """
    plan.check()
    texts = chosen(texts, plan)
    if completed is not None:
        texts = manifests.pending(texts, completed, "source")
    if plan.tokens_column:
        rows = texts.select("source", "_place", "ord", F.col(plan.tokens_column).alias("tokens")).where(F.size("tokens") > 0)
    else:
        column = scans.text_column(texts, plan.text_column, strict=True)
        rows = tokenise(texts.where(F.col(column).isNotNull()).select("source", "_place", "ord", F.col(column).alias("text")), encoder, plan.tokenizer)
    if plan.one_shard_per_source:
        cut = rows.select("source", F.lit(0).cast("long").alias("shard"), "ord", F.concat("tokens", F.array(F.lit(0).cast("long"))).alias("tokens"))
    elif plan.ordered_part:
        cut = shard_slices(rows.withColumn("source", F.lit("stream")), plan.shard_tokens, tail=plan.keep_tail, order=("_place", "ord"))
    else:
        cut = shard_slices(rows, plan.shard_tokens, tail=plan.keep_tail)
    # Names are paths in some sources; a shard's is one name.
    flat = F.regexp_replace(F.regexp_replace("source", r"\.parquet$", ""), "/", "__")
    name = F.concat_ws("-", F.lit(plan.part_id or None), flat, F.lpad(F.col("shard").cast("string"), 6, "0"))
    if plan.dry_run:
        return cut.groupBy(name.alias("shard_name"), "source").agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"))
    path = plan.manifest()
    npytok.write_shards(cut.select(name.alias("shard_name"), "ord", "tokens"), folder, source="shard_name", manifest=path, document=plan.document())
    if plan.part_id and not plan.part_manifest_only:
        merge_manifest(folder, path)
    plain = F.when(F.lit(bool(plan.part_id)), F.regexp_replace("source_file", f"^{plan.part_id}-", "")).otherwise(F.col("source_file"))
    return npytok.entries(spark, folder, path).withColumn("source", F.regexp_replace(plain, r"-[0-9]+$", ""))


def merge_manifest(folder: str, part: str) -> None:
    """Take a part's shards into the folder's manifest; a shard that it lists already is an error."""
    whole, own = ranges.join(folder, npytok.MANIFEST), json.loads(ranges.get(ranges.join(folder, part)))
    document = json.loads(ranges.get(whole)) if ranges.exists(whole) else {k: v for k, v in own.items() if k not in ("part_id", "distributed_run_id")} | {"shards": []}
    if twice := {s["key"] for s in document["shards"]} & {s["key"] for s in own["shards"]}:
        raise ValueError(f"shards are listed already: {sorted(twice)[:3]}")
    shards = sorted(document["shards"] + own["shards"], key=lambda s: s["key"])
    document |= {"total_shards": len(shards), "total_tokens": sum(s["n_tokens"] for s in shards), "shards": shards}
    ranges.put(whole, json.dumps(document).encode())
