"""Prompts and model calls (X5, X6, F22, F32, P13, P19): texts put together from rows, answers checked, calls repeated. The model is a function
(system text, user text) -> answer text that the caller passes in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.repair import loads
from orrery.functions.text import TOKEN, language, raw_tokens

ATTEMPTS = 2
TOKEN_LIMITS = {"hosted": 60_000, "local": 12_000}
FINDINGS_SYSTEM = "You find security threats in a system's architecture. Answer with one JSON object that has a list `threats`."
HINTS_SYSTEM = "You infer missing attributes of a system's components. Answer with one JSON object that has `nodes` by id and a list `edges`."
RERANK_SYSTEM = "You judge how relevant passages are to a query. Answer with one JSON object that has a list `scores` of objects with `idx` and `score`, from 0 to 1."
DIFF_SYSTEM = "You explain to engineers what changed between two versions of a system's architecture and of its threats, and what that means for security."
# Candidates that a prompt lists, passages that one call scores.
MOST_CANDIDATES, RERANK_BATCH = 30, 12
FORMATS = ("json", "markdown", "html", "threat-dragon")


class AnswerError(ValueError):
    pass


def has_findings(answer) -> bool:
    return isinstance(answer, dict) and isinstance(answer.get("threats"), list) and all(isinstance(t, dict) for t in answer["threats"])


def has_hints(answer) -> bool:
    return isinstance(answer, dict) and isinstance(answer.get("nodes", {}), dict) and isinstance(answer.get("edges", []), list)


def has_scores(answer) -> bool:
    return isinstance(answer, dict) and isinstance(answer.get("scores"), list)


def ask_json(call: Callable[[], str], valid: Callable[[object], bool], attempts: int = ATTEMPTS):
    """The call's answer as a JSON value that is valid; repeated when it isn't, an error after the last attempt."""
    why = "no attempt"
    for _ in range(attempts):
        try:
            if valid(answer := loads(call())):
                return answer
            why = "it lacks what was asked for"
        except ValueError as e:
            why = str(e)
    raise AnswerError(f"no usable answer in {attempts} attempts: {why}")


def token_limit(provider: str, given: int | None = None) -> int:
    """the limit of a prompt: as given, else by where the model runs."""
    return given if given else TOKEN_LIMITS["local" if provider in ("local", "ollama") else "hosted"]


def findings_prompt(graph_json: Column, context: Column, documents: Column, lang: str = "en", candidates: Column | None = None) -> Column:
    """The user text for finding threats: the graph, retrieved passages, context documents; parts that are null are left out. candidates, an array of structs with chunk_id, kb and source, are what may be
    cited: the first 30 are listed, where there are passages."""
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n\n# {title}\n"), c))
    out = F.concat(F.lit(f"Write all texts in {'English' if lang == 'en' else language(lang)}.\n\n# Graph\n"), graph_json, F.coalesce(part("Retrieved passages", context), F.lit("")), F.coalesce(part("Context documents", documents), F.lit("")))
    if candidates is None:
        return out
    named = lambda k, v: F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None")))
    listed = F.transform(F.slice(candidates, 1, MOST_CANDIDATES), lambda c: F.concat_ws(" ", F.lit("-"), *[named(k, c[k]) for k in ("chunk_id", "kb", "source")]))
    rule = "Where a passage supports a threat, cite it in `rag_sources` as {\"kb\", \"source\", \"chunk_id\", \"score\" from 0 to 1}, with a chunk_id of this list only:\n"
    cite = F.when((F.coalesce(context, F.lit("")) != "") & (F.size(candidates) > 0), F.concat(F.lit(f"\n\n# Citations\n{rule}"), F.array_join(listed, "\n")))
    return F.concat(out, F.coalesce(cite, F.lit("")))


def hints_prompt(skeleton: Column, lang: str = "en") -> Column:
    """F32: the user text for inferring attributes, from a graph's skeleton."""
    wanted = "For nodes: label, type, zone, zones, data (a list), auth, notes. For edges: from, to, protocol, data (a list). Leave out what you can't tell."
    return F.concat(F.lit(("" if lang == "en" else f"Write all texts in {language(lang)}.\n\n") + f"# Attributes\n{wanted}\n\n# Graph (nodes with id and label, edges with from, to and label)\n"), skeleton)


def diff_prompt(changes_json: str, lang: str = "en") -> str:
    """F32, K5: the user text for explaining a difference."""
    asked = "1. what changed in the graph\n2. what changed in the threats\n3. what that means for security\n4. whether the risk is higher or lower\n5. what to do"
    return ("" if lang == "en" else f"Write all texts in {language(lang)}.\n\n") + f"# Changes\n{changes_json}\n\n# Explain\n{asked}"


def model_reranker(model: Callable[[str, str], str], batch: int = RERANK_BATCH, most: int = 1200) -> Callable[[str, list[str]], list[float]]:
    """A reranker that asks a model for scores, `batch` passages a call; what it doesn't score, or not with a number, is 0, others are brought into [0, 1]."""

    def number(x) -> float | None:
        try:
            return float(x)
        except (TypeError, ValueError):
            return None

    def score(query: str, texts: list[str]) -> list[float]:
        out = [0.0] * len(texts)
        for start in range(0, len(texts), max(1, batch)):
            some = [" ".join((t or "").strip().split("\n")) for t in texts[start : start + max(1, batch)]]
            shown = "\n".join(f"[{i}] {t[:most] + '...' if len(t) > most else t}" for i, t in enumerate(some))
            answer = ask_json(lambda shown=shown: model(RERANK_SYSTEM, f"Query: {query}\n{shown}"), has_scores)
            for x in answer["scores"]:
                at, value = (number(x.get(k)) for k in ("idx", "score")) if isinstance(x, dict) else (None, None)
                if at is not None and value is not None and 0 <= int(at) < len(some):
                    out[start + int(at)] = max(0.0, min(1.0, value))
        return out

    return score


def rerank_prompt(query: Column, texts: Column, most: int = 1200) -> Column:
    """F32, F16: the user text for scoring passages: each cut at `most` characters, with its number."""
    cut = lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)
    return F.concat(F.lit("Query: "), query, F.lit("\n"), F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), cut(t))), "\n"))


def answers(prompts: DataFrame, model: Callable[[str, str], str], system: str = FINDINGS_SYSTEM, limit: int = TOKEN_LIMITS["hosted"]) -> DataFrame:
    """prompts(request_id, prompt) -> (request_id, answer, error): the model's answers as JSON text. A prompt beyond the limit, or without a usable answer, has an error instead; text is never cut."""
    import json

    valid = has_hints if system == HINTS_SYSTEM else has_findings

    def one(prompt: str) -> tuple[str | None, str | None]:
        import re

        n = len(re.findall(TOKEN, system)) + len(re.findall(TOKEN, prompt))
        if n > limit:
            return None, f"prompt has {n} tokens; the limit is {limit}"
        try:
            return json.dumps(ask_json(lambda: model(system, prompt), valid), ensure_ascii=False), None
        except AnswerError as e:
            return None, str(e)

    @F.pandas_udf("answer string, error string")
    def run(prompt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in prompt], columns=["answer", "error"])

    return prompts.select("request_id", run("prompt").alias("a")).select("request_id", "a.answer", "a.error")


def report_formats(asked: list[str] | None, default: tuple[str, ...] = ("json", "markdown")) -> list[str]:
    """The formats of a request: known ones, each once, in order; the default where none is asked for."""
    kept = [f for f in dict.fromkeys(x.strip().lower() for x in asked or []) if f in FORMATS]
    if asked and not kept:
        raise ValueError(f"no known report format in {asked}")
    return kept or list(default)


def n_tokens(c: Column) -> Column:
    return F.size(raw_tokens(c))
