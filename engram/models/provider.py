"""Model functions as column expressions, and the providers that offer them."""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.config import DEFAULTS, Settings
from engram.models import offline
from engram.models.prompts import CONFLICT_PROMPT, FACTS_PROMPT, RELATIONS_PROMPT


log = logging.getLogger(__name__)
TRIES = 3
WAIT_SECONDS = 0.5

class Provider(Protocol):
    """What the plans ask of a model. Replies that stand for data are JSON text."""

    def embed(self, text: Column) -> Column: ...

    def answer(self, prompt: Column) -> Column: ...

    def extract_facts(self, text: Column) -> Column: ...

    def extract_relations(self, text: Column) -> Column: ...

    def validate_conflict(self, candidate: Column, existing: Column) -> Column: ...


class OfflineProvider:
    """Deterministic stand-in without a model: rules over the text, all in the JVM."""

    def embed(self, text: Column) -> Column:
        return offline.embed(text)

    def answer(self, prompt: Column) -> Column:
        asked = F.regexp_extract(prompt, r"New message: ([^\n]*)\nAnswer:\z", 1)
        return F.when(asked != "", F.concat(F.lit("Noted: "), asked)).otherwise(
            F.concat(F.lit("Summary "), F.md5(prompt))
        )

    def extract_facts(self, text: Column) -> Column:
        return offline.extract_facts(text)

    def extract_relations(self, text: Column) -> Column:
        return offline.extract_relations(text)

    def validate_conflict(self, candidate: Column, existing: Column) -> Column:
        return offline.validate_conflict(candidate, existing)


class HttpProvider:
    """A hosted model behind one of two public wire formats, called in Arrow batches."""

    def __init__(
        self, kind: str, key: str, generation: str, embedding: str, base_url: str | None = None,
        batch: int = DEFAULTS.embed_batch,
    ) -> None:
        defaults = {
            "openai": "https://api.openai.com/v1",
            "gemini": "https://generativelanguage.googleapis.com/v1beta",
        }
        self.kind, self.key, self.batch = kind, key, batch
        self.generation, self.embedding = generation, embedding
        self.base_url = (base_url or defaults[kind]).rstrip("/")

    def _post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"}
        if self.kind == "openai":
            headers["Authorization"] = f"Bearer {self.key}"
        else:
            headers["x-goog-api-key"] = self.key
        request = urllib.request.Request(
            f"{self.base_url}/{path}", json.dumps(body).encode(), headers, method="POST"
        )
        with urllib.request.urlopen(request, timeout=30) as reply:
            return json.load(reply)

    def _vectors(self, texts: list[str]) -> list[list[float]]:
        if self.kind == "openai":
            reply = self._post("embeddings", {"model": self.embedding, "input": texts})
            return [d["embedding"] for d in sorted(reply["data"], key=lambda d: d["index"])]
        model = f"models/{self.embedding}"
        parts = [{"model": model, "content": {"parts": [{"text": t}]}} for t in texts]
        reply = self._post(f"{model}:batchEmbedContents", {"requests": parts})
        return [e["values"] for e in reply["embeddings"]]

    def _generate(self, prompt: str) -> str:
        if self.kind == "openai":
            body = {"model": self.generation, "messages": [{"role": "user", "content": prompt}]}
            choices = self._post("chat/completions", body).get("choices") or []
            return choices[0]["message"]["content"] if choices else "The model gave no answer."
        body = {"contents": [{"parts": [{"text": prompt}]}]}
        found = self._post(f"models/{self.generation}:generateContent", body).get("candidates") or []
        parts = found[0].get("content", {}).get("parts", []) if found else []
        return "".join(p.get("text", "") for p in parts) if parts else "The model gave no answer."

    def embed(self, text: Column) -> Column:
        call, size = self._vectors, self.batch

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out: list[list[float] | None] = []
                for start in range(0, len(texts), size):
                    part = texts.iloc[start:start + size].tolist()
                    found = _tried(call, part)
                    # callers go on without a vector, also where a reply has too few
                    whole = isinstance(found, list) and len(found) == len(part)
                    out.extend(found if whole else [None] * len(part))
                yield pd.Series(out)

        return vectors(text)

    def answer(self, prompt: Column) -> Column:
        return _text_call(self._generate)(prompt)

    def extract_facts(self, text: Column) -> Column:
        return self.answer(F.concat(F.lit(FACTS_PROMPT), text))

    def extract_relations(self, text: Column) -> Column:
        return self.answer(F.concat(F.lit(RELATIONS_PROMPT), text))

    def validate_conflict(self, candidate: Column, existing: Column) -> Column:
        listed = F.array_join(F.transform(existing, lambda e: F.concat(F.lit("- "), e)), "\n")
        return self.answer(F.concat(
            F.lit(CONFLICT_PROMPT), F.lit("Candidate: "), candidate, F.lit("\nExisting:\n"), listed
        ))


def _tried(call: Callable, given, tries: int = TRIES, wait: float = WAIT_SECONDS):
    """The call's result, or nothing; the reason of a failure goes to the executor's log.

    A transport failure is tried again after a wait that doubles; a reply that is no JSON or lacks a
    field is not.
    """
    for turn in range(tries):
        try:
            return call(given)
        except OSError as reason:
            log.warning("model call %d of %d failed: %s", turn + 1, tries, reason)
            if turn + 1 < tries:
                time.sleep(wait * 2 ** turn)
        except (ValueError, LookupError, TypeError, AttributeError) as reason:
            log.warning("model reply refused: %r", reason)
            return None
    return None


def _text_call(call: Callable[[str], str]):
    """A model call per text; a failed one gives null, and the task goes on."""

    def answer(prompt: str | None) -> str | None:
        return _tried(call, prompt) if prompt is not None else None

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(answer)

    return run


def provider_for(settings: Settings = DEFAULTS, env: dict[str, str] | None = None) -> Provider:
    """The configured provider; an unknown name means the default one."""
    env = dict(os.environ) if env is None else env
    kind = settings.provider if settings.provider in ("openai", "gemini") else "gemini"
    if settings.provider == "offline":
        return OfflineProvider()
    prefix = kind.upper()
    key = env.get(f"{prefix}_API_KEY") or env.get("LLM_API_KEY", "")
    if not key:
        raise ValueError(f"set {prefix}_API_KEY or LLM_API_KEY, or the provider 'offline'")
    generation, embedding = {
        "openai": ("gpt-4o-mini", "text-embedding-3-small"),
        "gemini": ("gemini-2.5-flash", "text-embedding-004"),
    }[kind]
    return HttpProvider(
        kind, key, env.get(f"{prefix}_GENERATION_MODEL") or generation,
        env.get(f"{prefix}_EMBEDDING_MODEL") or embedding, batch=settings.embed_batch,
    )
