"""An independent model of verdict texts in plain Python, written from the format's description."""

from __future__ import annotations

import hashlib
import json
import re

FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
BARE = re.compile(r"\{.*\}", re.S)


def body(raw: str) -> str | None:
    found = FENCE.search(raw)
    if found:
        return found[1]
    found = BARE.search(raw)
    return found[0] if found else None


def token(raw: str) -> bool | None:
    for line in raw.splitlines():
        line = line.strip()
        if not line or line.startswith("```"):
            continue
        line = line.strip("`").rstrip(".!").strip()
        if line in ("Refuted", "Not Refuted"):
            return line == "Refuted"
    return None


def fingerprint(findings: list[dict]) -> str:
    kept = [f for f in findings if any(f[k].strip() for k in ("kind", "location", "detail"))]
    tokens = sorted(f"{f['kind']}:{f['location']}:{f['detail']}" for f in kept)
    return hashlib.sha256("|".join(tokens).encode()).hexdigest()[:16] if tokens else ""


def _no_constant(x):
    raise ValueError(x)


def parse(raw: str) -> dict:
    """tier, refuted, blocking, confidence and the findings' fingerprint."""
    text = body(raw)
    if text is not None:
        try:
            d = json.loads(text, parse_constant=_no_constant)
            refs, found, sure = d.get("evidence_refs", []), d.get("findings", []), d.get("confidence", "medium")
            if not (isinstance(refs, list) and isinstance(found, list) and isinstance(sure, str) and all(isinstance(x, dict) for x in [*refs, *found])):
                raise TypeError
            found = [{k: f.get(k, "") for k in ("kind", "location", "detail")} for f in found]
            if not all(isinstance(v, str) for f in found for v in f.values()):
                raise TypeError
            sure = sure.strip().lower()
            return {"tier": 1, "refuted": d.get("refuted", True) is not False, "blocking": d.get("blocking") in ("contradiction", "unverifiable"), "confidence": sure if sure in ("high", "medium", "low") else "unknown", "fp": fingerprint(found)}
        except (ValueError, TypeError):
            pass
    said = token(raw)
    if said is not None:
        return {"tier": 2, "refuted": said, "blocking": False, "confidence": "unknown", "fp": ""}
    return {"tier": 3, "refuted": True, "blocking": True, "confidence": "unknown", "fp": ""}
