"""Small driver-side inputs: exclude rules in TOML, and optional dependencies in POM files."""

from __future__ import annotations

import os
import re
import tomllib

RULE_KEYS = {"owner", "member", "descriptor", "kind", "reason"}


def exclude_rules(text: str) -> list[tuple]:
    """(rule_id, owner, member, descriptor, kind, reason). Raises ValueError on rules that don't say what and why."""
    out = []
    d = tomllib.loads(text)
    if set(d) - {"exclude"}:
        raise ValueError(f"unknown keys: {sorted(set(d) - {'exclude'})}")
    for i, r in enumerate(d.get("exclude", [])):
        if set(r) - RULE_KEYS:
            raise ValueError(f"rule {i}: unknown keys {sorted(set(r) - RULE_KEYS)}")
        if not r.get("reason", "").strip():
            raise ValueError(f"rule {i}: a reason is required")
        if not (r.get("owner") or r.get("kind")):
            raise ValueError(f"rule {i}: an owner or a kind is required")
        if r.get("member") and not r.get("owner"):
            raise ValueError(f"rule {i}: a member needs an owner")
        if r.get("descriptor") and not r.get("member"):
            raise ValueError(f"rule {i}: a descriptor needs a member")
        if "*" in r.get("owner", "")[:-1]:
            raise ValueError(f"rule {i}: only one * at the end of an owner")
        kind = r.get("kind")
        out.append((i, r.get("owner", "").replace(".", "/") or None, r.get("member"), r.get("descriptor"), kind.replace("_", " ") if kind else None, r["reason"]))
    return out


def optional_dependencies(pom: str) -> set[tuple[str, str]]:
    """(group, name) that the POM has as optional only; what is also required without conditions is not optional."""
    text = re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", " ", pom, flags=re.S)
    for tag in ("dependencyManagement", "build", "plugins", "reporting", "exclusions"):
        text = re.sub(rf"<{tag}\b[^>]*>.*?</{tag}\s*>", " ", text, flags=re.S)
    always = re.sub(r"<profiles\b.*?</profiles\s*>", " ", text, flags=re.S)

    def found(part: str) -> tuple[set, set]:
        optional, required = set(), set()
        for body in re.findall(r"<dependency\b[^>]*>(.*?)</dependency\s*>", part, re.S):
            get = lambda t, b=body: (m := re.search(rf"<{t}\s*>\s*(.*?)\s*</{t}\s*>", b, re.S)) and m[1]
            if get("classifier") or not (get("groupId") and get("artifactId")):
                continue
            (optional if get("optional") == "true" else required).add((get("groupId"), get("artifactId")))
        return optional, required

    return found(text)[0] - found(always)[1]


def locate_pom(jar: str, name: str, version: str) -> str | None:
    """The POM of a JAR: beside it, or in another checksum folder of the same name/version folders."""
    folder, want = os.path.dirname(jar), f"{name}-{version}.pom"
    if not folder:
        return None
    if os.path.isfile(beside := os.path.join(folder, want)):
        return beside
    above = os.path.dirname(folder)
    if os.path.basename(above) != version or os.path.basename(os.path.dirname(above)) != name:
        return None
    found = (os.path.join(above, x, want) for x in sorted(os.listdir(above)) if os.path.join(above, x) != folder)
    return next((x for x in found if os.path.isfile(x)), None)


def read_optional(jar: str, coordinate: str) -> set[tuple[str, str]]:
    """(group, name) that the POM of a JAR with the coordinate group:name:version declares optional; none without a POM."""
    parts = coordinate.split(":")
    pom = locate_pom(jar, parts[1], parts[2]) if len(parts) == 3 else None
    if pom is None:
        return set()
    try:
        with open(pom, encoding="utf-8", errors="replace") as f:
            return optional_dependencies(f.read())
    except OSError:
        return set()
