"""Calls of models behind an endpoint: retries, shards that keep the order, validated scores, completions, readiness."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd

from lodeweir.operators.maintenance import checked_scores, shard_ranges

#: Longest wait that an endpoint may ask for, in seconds; texts of one embedding request.
RETRY_AFTER_CAP, EMBED_BATCH = 30, 64


class EndpointError(RuntimeError):
    """A request that failed for good."""


def send_json(url: str, body: dict, timeout: float = 30.0) -> tuple[int, dict[str, str], bytes]:
    """(status, headers, body) of one POST request; failures of the transport are OSError."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


@dataclass
class Endpoint:
    """An endpoint with a base address; ``recover`` restarts a managed server and is tried once per request."""

    base: str
    send: Callable[[str, dict], tuple[int, dict[str, str], bytes]] = send_json
    retries: int = 2
    recover: Callable[[], None] | None = None
    sleep: Callable[[float], None] = time.sleep

    def url(self, suffix: str) -> str:
        """The base with a suffix, which it may have already."""
        base, suffix = self.base.rstrip("/"), suffix.lstrip("/")
        return base if base.endswith(suffix) else f"{base}/{suffix}"

    def post(self, suffix: str, body: dict) -> dict:
        """The decoded answer. Statuses 429 and 5xx are tried again after as many seconds as the endpoint asks for (30 at most),
        lost connections at once, and anew after one restart."""
        attempt, recovered = 0, False
        while True:
            try:
                status, headers, raw = self.send(self.url(suffix), body)
            except OSError as e:
                if attempt < self.retries:
                    attempt += 1
                    continue
                if self.recover and not recovered:
                    recovered, attempt = True, 0
                    self.recover()
                    continue
                raise EndpointError(f"{suffix}: {e}" + (" after a restart" if recovered else "")) from e
            if 200 <= status < 300:
                return json.loads(raw)
            if (status == 429 or status >= 500) and attempt < self.retries:
                attempt += 1
                wait = headers.get("retry-after", "")
                if wait.isdigit():
                    self.sleep(min(int(wait), RETRY_AFTER_CAP))
                continue
            raise EndpointError(f"{suffix}: status {status}: {raw[:200]!r}")

    def ready(self) -> str:
        """'ready', or why not, by one small request."""
        try:
            self.post("embeddings", {"input": ["ready?"]})
        except EndpointError as e:
            return str(e)
        return "ready"


def in_shards(items: Sequence, parallel: int, call: Callable[[Sequence], list]) -> list:
    """``call`` over balanced shards at once; results in the order of the items, and as many."""
    ranges = shard_ranges(len(items), parallel)
    if not ranges:
        return []
    with ThreadPoolExecutor(len(ranges)) as pool:
        parts = list(pool.map(lambda r: call(items[r[0] : r[1]]), ranges))
    for (a, b), part in zip(ranges, parts, strict=True):
        if len(part) != b - a:
            raise EndpointError(f"items {a} to {b}: {len(part)} results")
    return [x for part in parts for x in part]


def embedder(endpoint: Endpoint, kind: str = "document", parallel: int = 4) -> Callable[[pd.Series], pd.Series]:
    """An embedding model for plans.engine.Models; queries and documents may be told apart."""

    def one(texts: Sequence[str]) -> list:
        out = []
        for at in range(0, len(texts), EMBED_BATCH):
            part = list(texts[at : at + EMBED_BATCH])
            data = sorted(endpoint.post("embeddings", {"input": part, "kind": kind})["data"], key=lambda d: d["index"])
            if [d["index"] for d in data] != list(range(len(part))):
                raise EndpointError("vectors are no permutation of the texts")
            out += [list(map(float, d["embedding"])) for d in data]
        return out

    return lambda texts: pd.Series(in_shards(texts.tolist(), parallel, one), index=texts.index, dtype=object)


def reranker(endpoint: Endpoint, parallel: int = 4) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """A reranking model for plans.engine.Models: the documents of a query are scored in shards; scores are validated and clamped."""

    def score(queries: pd.Series, documents: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=queries.index)
        for query, rows in documents.groupby(queries.to_numpy(), sort=False):

            def one(part: Sequence[str], query: str = query) -> list:
                found = endpoint.post("rerank", {"query": query, "documents": list(part)})["results"]
                return checked_scores([(int(r["index"]), float(r["relevance_score"])) for r in found], len(part))

            out.loc[rows.index] = in_shards(rows.tolist(), parallel, one)
        return out

    return score


def completion(endpoint: Endpoint) -> Callable[[str, str], str]:
    """(system, user) -> text."""
    return lambda system, user: str(endpoint.post("chat/completions", {"messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]})["choices"][0]["message"]["content"])


def expander(complete: Callable[[str, str], str]) -> Callable[[str, int], list[str]]:
    """An expansion model for plans.engine.Models: a line of the answer is a rewrite; the query itself and repeats are left out."""

    def expand(query: str, most: int) -> list[str]:
        found: dict[str, str] = {}
        for line in complete(f"Give at most {most} other wordings of the search query, one a line.", query).splitlines():
            text = " ".join(line.strip(" -*\t").split())
            if text and text.lower() != query.strip().lower():
                found.setdefault(text.lower(), text)
        return list(found.values())[:most]

    return expand
