"""Vocabularies from tokenizer files in a local or mounted folder; nothing is fetched from a network."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions.tokens import byte_symbols
from ..workers import importable


@dataclass(frozen=True)
class EosLocation:
    """Where a configuration file names the end-of-sequence token: by id or by its text."""

    file: str
    path: tuple[str, ...]
    by_id: bool = False

    def find(self, read: Callable[[str], Any], id_of: Callable[[str], int | None]) -> int | None:
        """The id, or None for whatever reason it isn't there."""
        node = read(self.file)
        for step in self.path:
            node = node.get(step) if isinstance(node, dict) else None
        if self.by_id:
            return node if isinstance(node, int) and not isinstance(node, bool) and 0 <= node < 1 << 32 else None
        return id_of(node) if isinstance(node, str) else None


#: Looked at in this order.
COMMON_LOCATIONS = (
    EosLocation("generation_config.json", ("eos_token_id",), by_id=True),
    EosLocation("tokenizer_config.json", ("eos_token",)),
    EosLocation("tokenizer_config.json", ("eos_token", "content")),
)


def validate(name: str) -> str:
    """A model's name or revision: letters, digits and - _ . / only."""
    if not re.fullmatch(r"[^\W_]*(?:[-_./][^\W_]*)*", name):
        raise errors.TokenizersError(f"{name!r} holds characters other than letters, digits, '-', '_', '.' and '/'")
    return name


def without_prepend(normalizer: Any) -> Any:
    """A normalizer with its Prepend steps taken out; None if nothing is left to do."""
    if not isinstance(normalizer, dict) or normalizer.get("type") == "Prepend":
        return None
    if normalizer.get("type") == "Sequence":
        steps = [n for n in normalizer.get("normalizers") or [] if n.get("type") != "Prepend"]
        return normalizer | {"normalizers": steps}
    return normalizer


def space_replacement(decoder: dict) -> str | None:
    """The one character that a Replace decoder turns into a blank."""
    pattern = decoder.get("pattern")
    pattern = pattern.get("String") if isinstance(pattern, dict) else None
    return pattern if decoder.get("content") == " " and isinstance(pattern, str) and len(pattern) == 1 else None


class TokenProcessor:
    """Turns a vocabulary's token strings into bytes; ``level`` is "byte" or "fallback"."""

    def __init__(self, tokenizer: dict):
        decoder = tokenizer.get("decoder")
        if not isinstance(decoder, dict):
            raise errors.UnsupportedByTokenProcessor()
        self.space = " "
        if decoder.get("type") == "ByteLevel":
            self.level = "byte"
        elif decoder.get("type") == "Sequence" and any(d.get("type") == "ByteFallback" for d in decoder.get("decoders") or []):
            self.level = "fallback"
            found = (space_replacement(d) for d in decoder["decoders"] if d.get("type") == "Replace")
            self.space = next((s for s in found if s), " ")
        else:
            raise errors.UnsupportedByTokenProcessor()
        self._symbols = byte_symbols()

    def process(self, token: str) -> bytes:
        if self.level == "byte":
            try:
                return bytes(self._symbols[c] for c in token)
            except KeyError as e:
                raise errors.ByteProcessorFailed() from e
        if len(token.encode()) == 6 and token.startswith("<0x") and token.endswith(">"):
            if not re.fullmatch("[0-9A-Fa-f]{2}", token[3:5]):
                raise errors.ByteFallbackProcessorFailed()
            return bytes.fromhex(token[3:5])
        return token.replace(self.space, " ").encode()


def find_folder(model: str, revision: str | None = None, root: str | None = None) -> str:
    """The folder of a model: a path as it is, or a name under ``root``, in a folder of that name or in a snapshot cache (``models--owner--name/snapshots/<revision>``)."""
    if os.path.isdir(model):
        return model
    validate(model)
    revision = validate(revision or "main")
    cache = os.path.join(root or ".", "models--" + model.replace("/", "--"))
    try:
        with open(os.path.join(cache, "refs", revision), encoding="utf-8") as f:
            commit = f.read().strip()
    except OSError:
        commit = revision
    for folder in (os.path.join(root or ".", model), os.path.join(cache, "snapshots", commit)):
        if os.path.isdir(folder):
            return folder
    raise errors.TokenizersError(f"no folder for {model} (revision {revision}) under {root or 'the working folder'}; files are not fetched")


def read_json(folder: str, name: str) -> Any:
    """A JSON file of the folder, or None."""
    try:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def parse(read: Callable[[str], Any], model: str, locations: tuple[EosLocation, ...] = COMMON_LOCATIONS) -> tuple[int, list[tuple[bytes, int]]]:
    """The end-of-sequence id and (token, id) rows of a model whose files ``read`` gives as JSON, or None. Added tokens are taken as they are written, the model's own are decoded."""
    spec = read("tokenizer.json")
    if not isinstance(spec, dict) or not isinstance(spec.get("model"), dict):
        raise errors.TokenizersError(f"no tokenizer.json in {model}")
    spec["normalizer"] = without_prepend(spec.get("normalizer"))
    vocab = spec["model"].get("vocab") or {}
    base = dict(vocab) if isinstance(vocab, dict) else {row[0]: i for i, row in enumerate(vocab)}
    added = {t["content"]: t for t in spec.get("added_tokens") or []}
    id_of = lambda text: added[text]["id"] if text in added else base.get(text)
    eos = next((i for x in locations if (i := x.find(read, id_of)) is not None), None)
    if eos is None:
        raise errors.UnsupportedTokenizer(model=model, reason="EOS token id can't be located")
    try:
        processor = TokenProcessor(spec)
    except errors.UnsupportedByTokenProcessor as e:
        raise errors.UnsupportedTokenizer(model=model, reason=str(e)) from e
    rows = [(t["content"].encode(), t["id"]) for t in added.values() if not t.get("special") and t["id"] != eos]
    rows += [(processor.process(token), i) for token, i in base.items() if i != eos and token not in added]
    return eos, rows


def load(folder: str, locations: tuple[EosLocation, ...] = COMMON_LOCATIONS) -> tuple[int, list[tuple[bytes, int]]]:
    """:func:`parse` for a local folder."""
    return parse(lambda name: read_json(folder, name), folder, locations)


#: Rows of a batch that a task hands on at a time.
BATCH_ROWS = 1 << 14
MODELS = "model string, eos_token_id long, token binary, token_id long, error string"


def read_models(spark: SparkSession, *paths: str, locations: tuple[EosLocation, ...] = COMMON_LOCATIONS) -> DataFrame:
    """(model, eos_token_id, token, token_id, error): the vocabularies of all folders at or below ``paths``, on any file system that Spark reads.

    ``model`` is the folder's path. Files are read and decoded in the executors, a model in one task. A folder whose tokenizer can't be read gives one
    row with its ``error`` and no token; folders that lack ``tokenizer.json`` give none.
    """
    importable(spark)
    names = sorted({"tokenizer.json"} | {x.file for x in locations})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(list(paths))
    parts = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("model"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    # A group holds one file of each name.
    models = parts.filter(F.col("name").isin(names)).groupBy("model").agg(F.collect_list(F.struct("name", "content")).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = {x["name"]: x["content"] for x in row["files"]}

                def read(name: str, found: dict = found) -> Any:
                    try:
                        return json.loads(found[name])
                    except (KeyError, ValueError):
                        return None

                if "tokenizer.json" not in found:
                    continue
                eos, rows, error = None, [(None, None)], None
                try:
                    eos, rows = parse(read, row["model"], locations)
                except errors.LatticeError as e:
                    error = str(e)
                except (AttributeError, KeyError, TypeError) as e:
                    error = f"The files have another form than a tokenizer's: {e!r}"
                for at in range(0, len(rows), BATCH_ROWS):
                    some = rows[at : at + BATCH_ROWS]
                    same = [pa.array([x] * len(some), kind) for x, kind in ((row["model"], pa.string()), (eos, pa.int64()), (error, pa.string()))]
                    tokens, ids = pa.array([t for t, _ in some], pa.binary()), pa.array([i for _, i in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([same[0], same[1], tokens, ids, same[2]], ["model", "eos_token_id", "token", "token_id", "error"])

    return models.mapInArrow(run, MODELS)
