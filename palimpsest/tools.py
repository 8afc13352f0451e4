"""The engine's methods as tools: names, what they do and the schemas of their arguments, and a call by name with checked arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palimpsest.facade import Engine
from palimpsest.operators import memory


def _text(what: str, **more) -> dict:
    return {"type": "string", "description": what, **more}


def _number(default: int, most: int, least: int = 1) -> dict:
    return {"type": "integer", "default": default, "minimum": least, "maximum": most}


_PROJECT, _ITEMS = _text("Project id, like -home-me-work."), {"type": "array", "items": {"type": "string"}}
_GLOBAL = {"type": "boolean", "description": "Of all projects, whatever the project. Without it and a project, the one that was active last."}
_SCOPE = _text("When it applies.", enum=["auto", "always", "glob", "manual"])
#: name: (what it does, arguments, required ones)
TOOLS = {
    "recall": ("Search all indexed chunks; the best that fit the budget, with where they come from.", {"query": _text("What to look for."), "limit": _number(10, 50), "project": _PROJECT}, ["query"]),
    "list_sessions": ("The latest sessions.", {"project": _PROJECT, "limit": _number(20, 200)}, []),
    "list_projects": ("Projects with their sessions and when they were last seen.", {}, []),
    "list_unsummarized_sessions": ("The latest sessions without a summary.", {"project": _PROJECT, "limit": _number(20, 100)}, []),
    "get_session_transcript": ("A session's transcript, cut at a number of bytes.", {"session": _text("Session id."), "most_bytes": _number(60_000, 400_000, 1000)}, ["session"]),
    "save_session_summary": ("Keep a summary of a session.", {"session": _text("Session id."), "text": _text("Two to four sentences, at most 4000 characters."), "items": _ITEMS}, ["session", "text"]),
    "list_topics": ("Topics with their names and sizes.", {}, []),
    "name_topic": ("Name a topic.", {"topic": _text("Topic id."), "label": _text("3 to 80 characters."), "description": _text("At most 300 characters.")}, ["topic", "label"]),
    "remember": ("Keep a fact; one that is nearly equal takes its place.", {"project": _PROJECT, "content": _text("The fact."), "scope": _SCOPE, "globs": _ITEMS, "pinned": {"type": "boolean"}, "source": _text("Who says so.", enum=list(memory.SOURCES)), "global": _GLOBAL}, ["content"]),
    "update_memory": ("Change a memory.", {"id_": _text("Memory id."), "content": _text("The fact."), "pinned": {"type": "boolean"}, "scope": _SCOPE, "globs": _ITEMS}, ["id_"]),
    "forget": ("Delete a memory.", {"id_": _text("Memory id.")}, ["id_"]),
    "list_memories": ("A project's memories, pinned ones first.", {"project": _PROJECT, "scope": _SCOPE, "limit": _number(100, 500), "global": _GLOBAL}, []),
    "help": ("What the tools do.", {}, []),
}


def schemas() -> list[dict]:
    """Name, description and inputSchema of each tool."""
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]


def help_text() -> str:
    return "\n".join(f"{n}({', '.join(a if a in r else a + '?' for a in p)}): {d}" for n, (d, p, r) in TOOLS.items())


_KINDS = {"string": str, "integer": int, "boolean": bool, "array": list}


def call(engine: Engine, name: str, arguments: dict | None = None):
    """A tool's result: rows as dictionaries, or what the method returns. ValueError for unknown tools and for arguments that don't fit
    the schema; numbers beyond their bounds are clamped."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name}")
    _, known, required = TOOLS[name]
    own = {k: v for k, v in (arguments or {}).items() if v is not None}
    if missing := [r for r in required if r not in own]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    for k, v in own.items():
        if k not in known:
            raise ValueError(f"{name} takes no {k}")
        kind = known[k]["type"]
        if not isinstance(v, _KINDS[kind]) or kind == "integer" and isinstance(v, bool):
            raise ValueError(f"{k} must be of type {kind}")
        if kind == "integer":
            own[k] = min(max(v, known[k]["minimum"]), known[k]["maximum"])
    own = {k: p["default"] for k, p in known.items() if "default" in p} | own
    if "global" in known:
        everywhere = own.pop("global", False)
        own["project"] = memory.GLOBAL if everywhere else own.get("project") or engine.recent_project()
        if not own["project"]:
            raise ValueError(f"{name} needs project, as none is known yet")
    if name == "help":
        return help_text()
    out = getattr(engine, name)(**own)
    if isinstance(out, DataFrame):
        return [r.asDict(recursive=True) for r in out.collect()]
    if name == "recall":
        return {"items": [r.asDict() for r in out["items"].orderBy("rank").collect()], "memories": out["memories"], "stats": out["stats"].first().asDict(), "truncated": out["truncated"]}
    return out
