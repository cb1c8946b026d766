"""Hashes that identify findings, secrets and snippets."""

from __future__ import annotations


def fingerprint(path: str, rule_id: str, secret: str) -> str:
    """Identity of a finding; the line number drifts and is left out."""
    return f"substring(sha2(concat_ws(':', {path}, {rule_id}, {secret}), 256), 1, 32)"


def secret_hash(secret: str) -> str:
    return f"substring(sha2({secret}, 256), 1, 16)"


def finding_key(path: str, line_no: str, rule_id: str) -> str:
    """Key of one reported place, for joining verdicts back to findings."""
    joined = f"concat_ws(':', {path}, cast({line_no} as string), {rule_id})"
    return f"substring(sha2({joined}, 256), 1, 32)"


def snippet_hash(snippet: str, *, ephemeral: bool = False) -> str:
    digits = 16 if ephemeral else 64
    hashed = f"concat('sha256:', substring(sha2({snippet}, 256), 1, {digits}))"
    return f"if({snippet} = '', '', {hashed})"
