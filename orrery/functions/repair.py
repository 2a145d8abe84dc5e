"""repair of model answers that should be JSON. Plain Python, for the driver or as a pandas UDF where from_json gives null."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fenced(text: str) -> str:
    """What a Markdown fence encloses; else from the first brace or bracket on."""
    text = text.strip()
    if m := re.search(r"```(?:json)?\s*\n?(.*?)(?:```|\Z)", text, re.S | re.I):
        text = m[1].strip()
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=0)
    return text[at:]


def closed(text: str) -> str:
    """A document cut short: back to the last complete value, then the brackets that are open."""
    stack, quoted, escaped, safe = [], False, False, []
    for i, ch in enumerate(text):
        if quoted:
            escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
            safe.append((i + 1, list(stack)))
            if not stack:
                return re.sub(r",(\s*[}\]])", r"\1", text[: i + 1])
        elif ch == "," and stack:
            safe.append((i, list(stack)))
    for end, open_ in reversed(safe):
        whole = re.sub(r",(\s*[}\]])", r"\1", text[:end].rstrip().rstrip(",") + "".join(reversed(open_)))
        try:
            json.loads(whole)
            return whole
        except ValueError:
            continue
    return text


def loads(text: str):
    """The JSON value of an answer, repaired if need be; ValueError if it can't be."""
    body = fenced(text or "")
    for attempt in (body, re.sub(r",(\s*[}\]])", r"\1", body), closed(body)):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    raise ValueError("not JSON, even repaired")


def repaired(answer: Column) -> Column:
    """The answer as JSON text, null where it can't be repaired. Answers that parse don't leave the JVM's parser in vain: callers try from_json first."""

    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(loads(t), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one)

    return fix(answer)
