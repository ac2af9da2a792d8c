"""Rules, control and projection files."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from ..functions.replies import Areas
from ..functions.text import MODES, UNCLEAR
from ..operators.classify import Rule

MATCHERS = ("title_any", "channel_any", "tag_any", "text_any", "category_any")


class BadConfig(ValueError):
    pass


@dataclass
class Config:
    topics: dict[str, str]
    rules: list[Rule] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def areas(self) -> list[str]:
        return list(self.topics)


def parse(data: dict, default_areas: list[str] = [UNCLEAR]) -> Config:  # noqa: B006
    """Checks a rules file's content; without topics the default areas hold."""
    topics = {str(t.get("id") or ""): str(t.get("description") or "") for t in data.get("topics") or [{"id": a} for a in default_areas]}
    if "" in topics:
        raise BadConfig("a topic has no id")
    for name in topics:
        if "/" in name:
            raise BadConfig(f"topic {name!r} is no area: subjects are free, list {name.split('/')[0]!r}")
    if UNCLEAR not in topics:
        raise BadConfig(f"the topics lack {UNCLEAR!r}")
    aliases = {str(k): str(v) for k, v in (data.get("sub_aliases") or {}).items()}
    areas, rules = Areas(tuple(topics), tuple(aliases.items())), []
    for k, r in enumerate(data.get("rules") or [], 1):
        name = str(r.get("id") or "")
        if not name:
            raise BadConfig(f"rule {k} has no id")
        if name in {x.id for x in rules}:
            raise BadConfig(f"rule {name!r} stands twice")
        topic = areas.topic(str(r.get("topic") or ""))
        if topic is None:
            raise BadConfig(f"rule {name!r} names an unknown area: {r.get('topic')!r}")
        if (r.get("mode") or "") not in (*MODES, ""):
            raise BadConfig(f"rule {name!r} has no such mode: {r.get('mode')!r}")
        matchers = {m: tuple(map(str, r.get(m) or ())) for m in MATCHERS}
        if not any(matchers.values()):
            raise BadConfig(f"rule {name!r} matches nothing")
        rules.append(Rule(name, topic, r.get("mode") or "", **matchers))
    return Config(topics, rules, aliases)


def load(path: str) -> Config:
    import yaml

    return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def load_control(path: str) -> dict:
    """stop, pin, merge, split and keep; a missing file wishes nothing."""
    import yaml

    p = Path(path)
    found = (yaml.safe_load(p.read_text(encoding="utf-8")) or {}) if p.exists() else {}
    return {"stop": False, "pin": {}, "merge": [], "split": [], "keep": []} | found


def load_projection(path: str) -> list[tuple[str, str]]:
    import yaml

    found = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("map") or {}
    if not found:
        raise BadConfig("an empty projection would hide every topic")
    return sorted((str(k), str(v)) for k, v in found.items())


def _plain(text: str) -> str:
    return " ".join(text.split())


def _quoted(text: str) -> str:
    """As it is where YAML reads plain words of letters, digits, dashes and slashes; else in quotes."""
    import json
    import re

    words = re.fullmatch(r"[A-Za-z][A-Za-z0-9]*(?:[-/][A-Za-z0-9]+)*", text)
    return text if words and text.lower() not in ("yes", "no", "on", "off", "true", "false", "null", "y", "n") else json.dumps(text, ensure_ascii=False)


def write_projection(rows: list[tuple[str, str, int]], path: str, header: list[str] = []) -> None:  # noqa: B006
    """rows: old topic, new topic, views; the most watched parents come first."""
    parents: dict[str, int] = {}
    for _, new, views in rows:
        parents[new.split("/")[0]] = parents.get(new.split("/")[0], 0) + views
    order = sorted(parents, key=lambda p: (-parents[p], p))
    lines = [*(f"# {h}" for h in header), "map:"]
    for parent in order:
        lines.append(f"  # {_plain(parent)}: {parents[parent]} views")
        lines += [f"  {_quoted(old)}: {_quoted(new)}" for old, new, _ in sorted(rows) if new.split("/")[0] == parent]
    own = Path(f"{path}.part")
    own.write_text("\n".join(lines) + "\n", encoding="utf-8")
    own.replace(path)
