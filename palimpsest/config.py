"""Settings: defaults, bounds, and a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class HookConfig:
    score_threshold: float = 0.60
    limit: int = 5
    token_budget: int = 1500
    min_words: int = 4
    scope: str = "project"
    max_always_injected: int = 3


@dataclass(frozen=True)
class Config:
    auto_promote: bool = False
    dedupe_threshold: float = 0.95
    memory_reconcile: bool = False
    notes_file: str = "NOTES.md"
    hook: HookConfig = field(default_factory=HookConfig)

    def dedupe(self) -> float:
        return min(max(self.dedupe_threshold, 0.5), 0.999)


def load(path: str) -> Config:
    """Defaults where there is no file; ValueError where it is malformed; unknown keys are passed over."""
    try:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    except FileNotFoundError:
        return Config()
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    hook = {k: v for k, v in raw.get("hook", {}).items() if k in HookConfig.__dataclass_fields__}
    own = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__ and k != "hook"}
    return replace(Config(), **own, hook=replace(HookConfig(), **hook))


def validate(c: Config) -> Config:
    """c, or ValueError."""
    h = c.hook
    for ok, what in (
        (0 <= h.score_threshold <= 1, "score_threshold is from 0 to 1"), (1 <= h.limit <= 100, "limit is from 1 to 100"), (1 <= h.token_budget <= 200_000, "token_budget is from 1 to 200000"),
        (0 <= h.min_words <= 1000, "min_words is from 0 to 1000"), (h.scope in ("project", "global"), "scope is project or global"), (0 <= h.max_always_injected <= 100, "max_always_injected is from 0 to 100"),
    ):
        if not ok:
            raise ValueError(what)
    return c


def save(c: Config, path: str) -> None:
    show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
    raw = asdict(c)
    hook = raw.pop("hook")
    with open(path, "w") as f:
        f.write("".join(f"{k} = {show(v)}\n" for k, v in raw.items()) + "\n[hook]\n" + "".join(f"{k} = {show(v)}\n" for k, v in hook.items()))
