"""Model replies for many prompts: providers in order, retries, a response cache, and the analysis of (text, class) pairs.

Calls run in the tasks, a partition at a time, so the number of partitions bounds how many are open at once. Replies are written
before anything is derived from them: no call is made twice because a task or an executor is lost later.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prompt_key, repair_json, reply_fields
from . import keyed_store
from . import prompts as P
from .ordered import by_bucket, dealt, stored
from .rules import Rule, confirm, decide, retrieve

REPLIES = "key string, text string, provider string, model string, error string, finish_reason string, latency_s double"


class RateLimited(Exception):
    """The provider asks to wait; the same call may work later."""


@dataclass
class Reply:
    text: str
    provider: str
    model: str
    error: str = ""
    finish_reason: str = ""
    latency_s: float = 0.0

    @property
    def ok(self) -> bool:
        return bool(self.text) and not self.error


@dataclass
class ChatEndpoint:
    """A chat-completions endpoint over HTTP. `key_env` names the variable that holds the key; none needed if it is empty."""

    name: str
    base_url: str
    model: str
    key_env: str = ""
    timeout: int = 120
    extra: dict = field(default_factory=dict)
    max_tokens: int = 1_400

    @property
    def available(self) -> bool:
        return bool(self.base_url) and (not self.key_env or bool(os.environ.get(self.key_env)))

    def complete(self, system: str, user: str, temperature: float) -> Reply:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "max_tokens": self.max_tokens, **self.extra}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[self.key_env]}"} if self.key_env else {})
        began = time.time()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers), timeout=self.timeout) as r:
                data = json.loads(r.read())
            choice = data["choices"][0]
            text, finish = choice["message"]["content"] or "", str(choice.get("finish_reason") or "")
        except urllib.error.HTTPError as e:
            if e.code in (429, 503, 529):
                raise RateLimited(f"{self.name}: HTTP {e.code}") from e
            return Reply("", self.name, self.model, f"HTTP {e.code}")
        except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
            return Reply("", self.name, self.model, f"{type(e).__name__}: {e}"[:200])
        if not text.strip():  # an empty message is a failure of the transport, not a judgement
            return Reply("", self.name, self.model, f"empty content (finish_reason={finish or 'none'})", finish)
        return Reply(text, self.name, self.model, finish_reason=finish, latency_s=round(time.time() - began, 2))


@dataclass
class Offline:
    """A deterministic stand-in that reads the scaffold of a prompt and answers as the rules do. Not a language model."""

    name: str = "mock"
    model: str = "rules"
    available: bool = True

    def complete(self, system: str, user: str, temperature: float) -> Reply:
        if '"correctness"' in system:
            answer = {"correctness": 7, "severity": 6, "profitability": 5, "verdict": "confirmed", "rebuttal": "accepted on static evidence alone"}
            return Reply(json.dumps(answer), self.name, self.model)

        def first(pattern: str, default: str) -> str:
            m = re.search(pattern, user, re.M)
            return m[1] if m else default

        head = user.find(P.CODE_HEAD)
        stop = user.find("\n## ", head + 1) if head >= 0 else -1
        code = "" if head < 0 else user[head + len(P.CODE_HEAD) : stop if stop >= 0 else len(user)]
        name, holds = first(r"^id: (\S+)", ""), first(r"^static_precheck: (\w+)", "false") == "true"
        draw = random.Random(int(hashlib.sha256((name + code[:200]).encode()).hexdigest()[:8], 16)).random()
        terms, lines = first(r"^must_call_hint: (.+)$", ""), code.strip().splitlines()
        answer = {
            "vuln_id": name, "scenario_match": holds, "property_match": holds, "confidence": round(0.55 + 0.35 * draw, 2) if holds else 0.05,
            "key_variables": terms.split(",")[:3] if terms else [], "vulnerable_statements": [lines[0][:120]] if lines else [],
            "attack_path": "all static conditions of the class hold here" if holds else "", "severity": "high" if holds else "low",
        }
        return Reply(json.dumps(answer), self.name, self.model)


def complete(providers: list, system: str, user: str, temperature: float, retries: int, backoff: float) -> Reply:
    """The first good reply of the providers in order. A limited one is asked again after a growing wait, a failing one is passed over."""
    error = "no provider available"
    for provider in providers:
        for attempt in range(retries):
            try:
                reply = provider.complete(system, user, temperature)
            except RateLimited as e:
                error = str(e)
                time.sleep(backoff * 2**attempt)
                continue
            if reply.ok:
                return reply
            error = reply.error or "provider returned nothing"
            break
    return Reply("", "none", "none", error)


def ask(rows: DataFrame, providers: list, cache: str | None = None, retries: int = 4, backoff: float = 2.0, fail_fast: int = 8, prompts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds text, provider, model, error and cached to rows with a prompt (system, user, temperature).

    With `prompts`, a function that adds a prompt to each of the rows it is given, the rows come without and no prompt is written:
    all are made for their keys, and those that are asked once more. Equal prompts are asked once. With `cache`, the folder of a
    keyed store, good replies of earlier runs are used and those of this run are added. A task that has only failures after
    `fail_fast` calls stops the job, and so do as many failures in all if no call works: a dead endpoint must not pass for a model
    that finds nothing (0: never).
    """
    usable = [p for p in providers if p.available]
    if not usable:
        raise RuntimeError(f"no usable provider among {[p.name for p in providers]}")
    columns = rows.columns
    made = prompts or (lambda rows: rows)
    key = prompt_key(F.lit(usable[0].name), F.col("system"), F.col("user"), F.col("temperature"))
    keyed = stored(made(rows).select(*columns, key.alias("_key"), F.monotonically_increasing_id().alias("_at")))
    first = keyed.groupBy("_key").agg(F.min("_at").alias("_at"))
    known = keyed_store.lookup(first.select(F.col("_key").alias("key")), cache) if cache else None
    if known is not None:
        first = first.join(known.select("key"), F.col("_key") == F.col("key"), "left_anti")
    asked = made(keyed.join(first.select("_at"), "_at", "left_semi")).select("_key", "system", "user", "temperature")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good = bad = 0
        for batch in batches:
            rows = []
            for key, system, user, temperature in batch.itertuples(index=False):
                r = complete(usable, system, user, temperature, retries, backoff)
                good, bad = good + r.ok, bad + (not r.ok)
                if fail_fast and not good and bad >= fail_fast:
                    raise RuntimeError(f"{bad} calls failed and none worked; the last error: {r.error}")
                rows.append((key, r.text, r.provider, r.model, r.error, r.finish_reason, float(r.latency_s)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPLIES.split(", ")])

    fresh = stored(asked.mapInPandas(call, REPLIES))
    if fail_fast:
        good, bad, error = fresh.agg(F.count_if(F.col("error") == ""), F.count_if(F.col("error") != ""), F.max("error")).first()
        if not good and bad >= fail_fast:
            raise RuntimeError(f"{bad} calls failed and none worked; one error: {error}")
    replies = fresh.withColumn("cached", F.lit(False))
    if known is not None:  # written, as the store is about to hold the fresh ones too
        replies = stored(replies.unionByName(known.withColumn("cached", F.lit(True)).select(*replies.columns)))
    if cache:
        keyed_store.append(fresh.where("error = ''"), cache)
    return keyed.join(replies, F.col("_key") == F.col("key")).select(*columns, "text", "provider", "model", "error", "cached")


@dataclass(frozen=True)
class Settings:
    """How pairs are analysed. The temperatures are the auditors' (the first one is 0.4 cooler) and the critic's. `parts`: to how
    many tasks the slices are dealt, by default spark.sql.shuffle.partitions."""

    top_k: int = 3
    always: tuple[str, ...] = ()
    min_score: float = 0.0
    auditors: int = 2
    auditor_temperature: float = 0.7
    critic_temperature: float = 0.0
    use_critic: bool = True
    use_static: bool = True
    require_static: bool = True
    use_analyser: bool = True
    normalized: bool = False
    cache: str | None = None
    parts: int | None = None


def analyse(slices: DataFrame, rules: list[Rule], providers: list, settings: Settings = Settings(), chosen: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """Findings of all slices with an id: retrieval, confirmation, auditors, critic and the decision, one row for each slice and class.

    Texts are dealt and written once, by id; the other steps pass on pairs without texts, and prompts are made where the texts lie.

    Slices: id, protocol, contract, signature, solc_version, context, code, and if used normalized_code and analyser (array of
    checks). With `chosen` exemplars and their `pool`, prompts hold worked examples of other protocols. A pair whose calls
    failed has provider_error, one with a reply that is no JSON object has parse_failed; the two are never mixed.
    """
    s, use = settings, "normalized_code" if settings.normalized else "code"
    # The scaffold holds the rules' own verdict, so only the offline stand-in may see it.
    scaffold = all(isinstance(p, Offline) for p in providers if p.available)
    analyser = "analyser" if s.use_analyser and "analyser" in slices.columns else None
    if s.normalized:
        slices = slices.withColumn("normalized_code", F.coalesce(F.nullif("normalized_code", F.lit("")), "code"))
    spark, named = slices.sparkSession, [c for c in ("id", "protocol", "contract", "signature") if c in slices.columns]
    texts = dealt(slices.where("id is not null"), s.parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    pairs = retrieve(texts, rules, "code", top_k=s.top_k, min_score=s.min_score, forced=s.always)
    pairs = confirm(pairs.withColumnRenamed("score", "retrieval_score"), rules, "code", analyser)
    pairs = pairs.select("_row", *named, "class_id", "passed", "reason", "hits")
    if chosen is not None:
        pairs = P.with_exemplars(pairs, chosen, pool)
    with by_bucket(spark):
        pairs = stored(pairs)
    shown = texts.select("id", F.col("_row").alias("_own"), *sorted({"protocol", "contract", "signature", "solc_version", "context", use} | ({analyser} if analyser else set())))

    def beside(rows: DataFrame) -> DataFrame:
        """The rows with their texts. Row numbers are not compared as equal, as then Spark would deal the texts anew by both columns."""
        return shown.join(rows.hint("shuffle_hash"), "id").where(F.col("_own") - F.col("_row") == 0)

    user = P.auditor_prompt(rules, use, analyser, "exemplars" if chosen is not None else None, scaffold)
    warmth = F.when(F.col("attempt") > 0, s.auditor_temperature).otherwise(max(0.0, s.auditor_temperature - 0.4))
    attempts = pairs.select("_row", "id", "class_id", "passed", *(["exemplars"] if chosen is not None else []), F.explode(F.sequence(F.lit(0), F.lit(max(1, s.auditors) - 1))).alias("attempt"))
    told = ask(attempts, providers, s.cache, prompts=lambda rows: beside(rows).withColumns({"system": F.lit(P.AUDITOR), "user": user, "temperature": warmth}))
    told = told.withColumn("f", reply_fields(repair_json(F.col("text"))))
    got = F.col("error") == ""
    match = got & F.coalesce(F.col("f.property_match"), F.lit(False))
    rank = F.when(match, F.struct(F.coalesce("f.confidence", F.lit(0.0)).alias("c"), (-F.col("attempt")).alias("a")))
    best = told.groupBy("_row", "class_id").agg(
        F.max_by("f", rank).alias("best"),
        F.max_by("provider", F.when(F.col("provider") != "none", F.col("attempt"))).alias("provider"),
        F.max_by("model", F.when(F.col("provider") != "none", F.col("attempt"))).alias("model"),
        F.max(got & F.col("f").isNull()).alias("parse_failed"),
        F.coalesce(F.max_by("error", F.when(~got, F.col("attempt"))), F.lit("")).alias("provider_error"),
        F.count(F.lit(1)).alias("calls"),
    )
    found = pairs.join(stored(best), ["_row", "class_id"]).select("*", *[F.col(f"best.{c}").alias(c) for c in ("key_variables", "vulnerable_statements", "attack_path")])
    found = found.withColumn("rubric", F.when(F.col("best").isNotNull() & F.lit(s.use_critic), P.rubric_of(rules)))
    if s.use_critic:
        review = found.where("best is not null").select("_row", "id", "class_id", "key_variables", "vulnerable_statements", "attack_path")
        asks = {"system": P.critic_system(rules), "user": P.critic_prompt(rules, use), "temperature": F.lit(s.critic_temperature)}
        judged = ask(review, providers, s.cache, prompts=lambda rows: beside(rows).withColumns(asks)).withColumn("f", reply_fields(repair_json(F.col("text"))))
        judged = judged.select("_row", "class_id", "f.verdict", "f.correctness", "f.profitability", F.col("f.severity").try_cast("double").alias("severity_score"))
        found = found.join(judged, ["_row", "class_id"], "left")
    decided = decide(found.withColumn("confidence", F.coalesce("best.confidence", F.lit(0.5))), s.use_static, s.require_static, s.use_critic)
    there = F.col("best").isNotNull()
    default = F.try_element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.severity)]), F.col("class_id"))
    cut = lambda c, n: F.slice(F.when(there, F.coalesce(F.col(c), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), 1, n)
    return decided.select(
        *named, "class_id", "passed", "reason", "hits",
        (there & F.col("detected")).alias("detected"), F.when(there, F.coalesce("best.confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(there, F.coalesce("best.severity", default)).otherwise("low").alias("severity"),
        cut("key_variables", 10).alias("key_variables"), cut("vulnerable_statements", 5).alias("statements"), F.when(there, F.substring(F.coalesce("attack_path", F.lit("")), 1, 900)).otherwise("").alias("attack_path"),
        "rubric", (there & F.col("inconsistent")).alias("inconsistent"), F.when(there, F.col("score")).otherwise(0.0).alias("score"), "provider", "model", "parse_failed", "provider_error", "calls",
    )
