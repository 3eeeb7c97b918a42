"""What a model pipeline says to a provider and makes of its answers; no network here."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable
from email.utils import parsedate_to_datetime

from ..functions import data
from ..operators.ledger import Constraint
from .reports import MAX_REPAIRS

TEXT = {"type": "string"}


def _object(**fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def _list(of: dict) -> dict:
    return {"type": "array", "items": of}


COMPRESS = _object(compressed=TEXT, kept=_list(TEXT), dropped=_list(TEXT))
VERIFY = _object(results=_list(_object(id=TEXT, preserved={"type": "boolean"}, evidence=TEXT)))
REPAIR = _object(compressed=TEXT, reinserted=_list(TEXT))


def without_key(schema, key: str = "additionalProperties"):
    """A schema without a keyword that one provider's dialect doesn't know."""
    if isinstance(schema, dict):
        return {k: without_key(v, key) for k, v in schema.items() if k != key}
    return [without_key(v, key) for v in schema] if isinstance(schema, list) else schema


def inventory(constraints: Iterable[Constraint]) -> str:
    """The constraints as prompts list them."""
    return "\n".join(f"- [{c.id}] ({c.type}, {'CRITICAL' if c.severity == 'critical' else 'minor'}) {' '.join(c.anchor.split())}" for c in constraints)


def compress_prompt(text: str, level: str, constraints: list[Constraint]) -> str:
    return f"Shorten this prompt ({level}) without changing what it demands. Keep literally:\n{inventory(constraints)}\n\nPROMPT:\n{text}"


def verify_prompt(text: str, output: str, constraints: list[Constraint]) -> str:
    return f"Say of each constraint whether the second prompt still demands it.\n{inventory(constraints)}\n\nFIRST:\n{text}\n\nSECOND:\n{output}"


def repair_prompt(output: str, missing: list[Constraint]) -> str:
    return f"Put these constraints back with as few words as possible.\n{inventory(missing)}\n\nPROMPT:\n{output}"


def estimated_tokens(text: str) -> int:
    """As ``functions.text.estimated_tokens``, for one string on the driver."""
    if not text:
        return 0
    words = len(text.split())
    size = (words / 0.75 + len(text) / 4) / 2 if words else len(text) / 4
    return max(1, math.floor(size + 0.5))


def estimated_cost(text: str, level: str, constraints: list[Constraint], compress_model: str, verify_model: str) -> dict | None:
    """Least and most dollars and calls of a run, from the prompts that would be sent."""
    if not text.strip():
        return None
    squeeze, judge = data.model(compress_model), data.model(verify_model)
    body, judged = estimated_tokens(text), max(200, 40 * len(constraints))

    def dollars(model: tuple, sent: str, received: int) -> float:
        return estimated_tokens(sent) / 1e6 * model[3] + received / 1e6 * model[4]

    first = dollars(squeeze, compress_prompt(text, level, constraints), body)
    check = dollars(judge, verify_prompt(text, text, constraints), judged)
    repair = dollars(squeeze, repair_prompt(text, [c for c in constraints if c.severity == "critical"]), body)
    return {"min_usd": first + check, "max_usd": first + 2 * check + MAX_REPAIRS * repair, "min_calls": 2, "max_calls": 3 + MAX_REPAIRS}


def ordered_models(available: list[str], preferred: list[str]) -> list[str]:
    """Preferred models first, each with its versions, then the rest as listed."""
    if not available:
        return list(preferred)
    family = {m: next((i for i, p in enumerate(preferred) if m == p or m.startswith(f"{p}-")), len(preferred)) for m in available}
    return sorted(available, key=lambda m: (family[m], m not in preferred and family[m] < len(preferred)))


def failure(errors: list[tuple[str, str]]) -> str:
    """One message for failures of several models."""
    messages = list(dict.fromkeys(m for _, m in errors))
    if len(messages) < 2:
        return messages[0] if messages else "The request failed for all models."
    return " | ".join(f"{model}: {message}" for model, message in errors)


STATUS = {
    400: "{0} rejected the request (400).",
    401: "Invalid {0} API key.",
    403: "{0} denied access for this key.",
    404: "{0} model not found. Pick another model.",
    413: "The prompt is too large for {0}. Compress a shorter prompt.",
    500: "{0} service error. Please retry shortly.",
    502: "{0} service error. Please retry shortly.",
    503: "{0} is temporarily overloaded. Please retry shortly.",
    529: "{0} is temporarily overloaded. Please retry shortly.",
}


def status_message(provider: str, status: int, detail: str | None = None, retry_after: int | None = None) -> str:
    if status == 429:
        said = f"{provider} rate limit reached. Retry in {retry_after}s." if retry_after is not None else f"{provider} rate limit or quota reached. Try again in a moment."
    else:
        said = STATUS.get(status, f"{{0}} API error {status}.").format(provider)
    return f"{said} {detail}" if detail else said


def retry_after(header: str | None, now: float | None = None) -> int | None:
    """Seconds of a retry-after header, given as seconds or as a date."""
    if not header:
        return None
    try:
        seconds = float(header)
        return math.ceil(seconds) if math.isfinite(seconds) and seconds >= 0 else None
    except ValueError:
        pass
    try:
        return max(0, math.ceil(parsedate_to_datetime(header).timestamp() - (time.time() if now is None else now)))
    except ValueError:
        return None


def short_detail(message, most: int = 200) -> str | None:
    flat = " ".join(message.split()) if isinstance(message, str) else ""
    return (flat if len(flat) <= most else flat[: most - 1] + "…") or None


def payload(label: str, answer: str):
    """The JSON of an answer; ValueError says what is wrong with it."""
    if not answer.strip():
        raise ValueError(f"{label} returned an empty response.")
    try:
        return json.loads(answer)
    except ValueError:
        raise ValueError(f"{label} returned a response that is not valid JSON.") from None
