"""Models behind interfaces: embeddings and extraction, run in tasks over batches."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from inkwell import schemas
from inkwell.functions import text as T


class EmbeddingError(RuntimeError):
    """A model's reply that cannot be used."""


class Refused(EmbeddingError):
    """A request that the endpoint finds malformed."""


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def extract(self, prompt: str) -> str:
        """The model's reply, which should hold JSON."""


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic vectors of unit length from hashed words, for runs without a model."""

    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[row, h % self.dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def _post(url: str, key: str, payload: dict, timeout: float, tries: int = 3) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    for n in range(1, tries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)
        except (urllib.error.URLError, TimeoutError) as why:
            if getattr(why, "code", None) == 400:  # the same request would be refused again
                raise Refused(f"{url} refused: {why.read().decode('utf-8', 'replace')[:500]}") from why
            if n == tries:
                raise EmbeddingError(f"no reply from {url}: {why}") from why
            time.sleep(2 * n)
    raise AssertionError


@dataclass(frozen=True)
class HttpEmbedder:
    """An endpoint of the common ``/embeddings`` form."""

    url: str
    model: str
    dims: int
    key: str = "none"
    timeout: float = 300.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        reply = _post(f"{self.url.rstrip('/')}/embeddings", self.key, {"model": self.model, "input": texts}, self.timeout)
        return checked([row["embedding"] for row in sorted(reply.get("data", []), key=lambda r: r["index"])], len(texts), self.dims)


def checked(vectors: list[list[float]], n: int, dims: int) -> list[list[float]]:
    if len(vectors) != n:
        raise EmbeddingError(f"{len(vectors)} vectors for {n} texts")
    for v in vectors:
        if len(v) != dims:
            raise EmbeddingError(f"a vector of {len(v)} numbers where {dims} were expected")
    return vectors


def query_vector(embedder: Embedder, query: str, instruction: str = "") -> list[float]:
    """The vector of a query; queries may carry an instruction, documents never do."""
    return embedder.embed([f"{instruction}{query}"])[0]


def embedded(rows: DataFrame, embedder: Embedder, text: str, into: str = "embedding", batch: int = 16) -> DataFrame:
    """Adds a vector to each row, computed in batches that cross documents. Null texts are embedded as empty."""
    keep = [c for c in rows.columns if c != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields) + f", `{into}` array<float>"

    def run(batches):
        for frame in batches:
            frame = frame[keep]
            vectors: list[list[float]] = []
            for k in range(0, len(frame), batch):
                part = ["" if t is None else t for t in frame[text].iloc[k : k + batch]]
                vectors += checked(embedder.embed(part), len(part), embedder.dims)
            yield frame.assign(**{into: pd.Series(vectors, index=frame.index, dtype=object)})

    return rows.mapInPandas(run, schema)


@dataclass(frozen=True)
class CapitalsExtractor:
    """Deterministic replies for runs without a model: capitalised word pairs are entities, neighbours are related."""

    def extract(self, prompt: str) -> str:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{2,} [A-Z][a-z]{2,}\b", prompt)))[:12]
        return json.dumps({
            "entities": [{"name": n, "type": "concept", "aliases": []} for n in names],
            "relations": [{"source": a, "target": b, "type": "related_to", "confidence": 0.5} for a, b in zip(names, names[1:])],
        })


INSTRUCTIONS = f"""\
Read the note and say which things it is about and how they are connected.

Answer with one JSON object and nothing else:
- "entities": a list of objects with "name", "type" (one of {", ".join(schemas.ENTITY_TYPES)}) and "aliases", other spellings that occur in the note;
- "relations": a list of objects with "source", "target", "type" (one of {", ".join(schemas.RELATION_TYPES)}) and "confidence", from 0 to 1.

Name a dozen entities at most, fewer where fewer matter: what a reader would look up. Leave out the note itself, the collection it is in, and common nouns of
computing that are not its subject. Use the usual full name of each. Both ends of a relation must be names from your list. Take the most exact type of relation
that the text supports, and be more confident the more plainly it is said. If there is nothing to name, give two empty lists."""


def _object(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required}


_TEXT = {"type": "string"}
REPLY_SCHEMA = _object(
    ["entities", "relations"],
    entities={"type": "array", "items": _object(["name", "type"], name=_TEXT, type={**_TEXT, "enum": list(schemas.ENTITY_TYPES)}, aliases={"type": "array", "items": _TEXT})},
    relations={"type": "array", "items": _object(["source", "target", "type"], source=_TEXT, target=_TEXT, type={**_TEXT, "enum": list(schemas.RELATION_TYPES)}, confidence={"type": "number"})},
)
#: Ways to ask for JSON, the strictest first; endpoints differ in what they accept.
FORMATS = ({"type": "json_schema", "json_schema": {"name": "kg_extraction", "strict": True, "schema": REPLY_SCHEMA}}, {"type": "json_object"}, None)
#: The first of FORMATS that an endpoint and model did not refuse, kept for the life of a process.
_accepted: dict[tuple[str, str], int] = {}


@dataclass(frozen=True)
class HttpExtractor:
    """An endpoint of the common ``/chat/completions`` form, asked at temperature 0 with the extraction instructions and the strictest format it accepts."""

    url: str
    model: str
    key: str = "none"
    max_tokens: int = 4000
    timeout: float = 900.0

    def extract(self, prompt: str) -> str:
        messages = [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": prompt}]
        payload = {"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "messages": messages}
        for n in range(_accepted.get((self.url, self.model), 0), len(FORMATS)):
            asked = payload | ({"response_format": FORMATS[n]} if FORMATS[n] else {})
            try:
                choice = _post(f"{self.url.rstrip('/')}/chat/completions", self.key, asked, self.timeout)["choices"][0]
            except Refused as why:
                if n + 1 == len(FORMATS) or re.search("context (size|length)", str(why), re.I):  # another format would not help
                    raise
                continue
            _accepted[self.url, self.model] = n
            if choice.get("finish_reason") == "length":
                raise ValueError(f"reply cut off at {self.max_tokens} tokens")
            return choice["message"]["content"]
        raise AssertionError


def extraction_prompts(documents: DataFrame, size: int = 1500) -> DataFrame:
    """``path``, ``window``, ``prompt``: tumbling windows of ``size`` words; a text that fits is passed as it is, a blank one not at all."""
    from pyspark.sql import functions as F

    ws = T.words("body")
    windows = F.when(F.size(ws) == 0, F.array().cast("array<string>")).when(F.size(ws) <= size, F.array("body")).otherwise(T.word_windows(ws, size))
    return documents.select("path", "title", F.posexplode(windows).alias("window", "text")).select(
        "path", "window", F.concat(F.lit("Path: "), "path", F.lit("\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), "text").alias("prompt")
    )


def extracted(prompts: DataFrame, extractor: Extractor) -> DataFrame:
    """``path``, ``window``, ``raw``, ``error``: the model's replies. A failed call is a row with its error, never a lost document."""

    def run(batches):
        for frame in batches:
            raw, error = [], []
            for p in frame["prompt"]:
                try:
                    raw.append(extractor.extract(p)), error.append(None)
                except Exception as why:  # the row says what went wrong
                    raw.append(None), error.append(f"{type(why).__name__}: {why}")
            yield pd.DataFrame({"path": frame["path"], "window": frame["window"], "raw": raw, "error": error})

    return prompts.mapInPandas(run, "path string, window int, raw string, error string")
