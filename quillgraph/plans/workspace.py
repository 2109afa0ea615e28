"""A workspace: its manifest, found by walking up from a folder, and what was decided about it."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

FOLDER = ".quillgraph"
MANIFEST = "workspace.json"
IGNORED = ("node_modules", "dist", "build", "target", "venv", "__pycache__", "vendor", "coverage")


class NotInitialized(LookupError):
    pass


def find_root(start: str | Path) -> Path | None:
    here = Path(start).resolve()
    return next((p for p in [here, *here.parents] if (p / FOLDER / MANIFEST).is_file()), None)


def require_root(start: str | Path) -> Path:
    found = find_root(start)
    if found is None:
        raise NotInitialized(f"no workspace at or above {start}")
    return found


def load_manifest(root: str | Path) -> dict:
    path = Path(root) / FOLDER / MANIFEST
    try:
        return json.loads(path.read_text("utf-8"))
    except (OSError, ValueError):
        return {}


def save_manifest(root: str | Path, manifest: dict) -> dict:
    """Written beside and renamed, so a reader sees the old or the new one."""
    folder = Path(root) / FOLDER
    folder.mkdir(parents=True, exist_ok=True)
    staged = folder / f".{MANIFEST}.new"
    staged.write_text(json.dumps(manifest, indent=2, sort_keys=True), "utf-8")
    os.replace(staged, folder / MANIFEST)
    return manifest


def init(root: str | Path, **settings) -> dict:
    """Makes a workspace once; afterwards its manifest comes back with ``already_exists``."""
    if (Path(root) / FOLDER / MANIFEST).is_file():
        return load_manifest(root) | {"already_exists": True}
    ignore = Path(root) / ".gitignore"
    lines = ignore.read_text("utf-8").splitlines() if ignore.is_file() else []
    if f"{FOLDER}/" not in lines:
        ignore.write_text("\n".join([*lines, f"{FOLDER}/"]) + "\n", "utf-8")
    return save_manifest(root, {"version": 1, "name": Path(root).resolve().name, **settings})


def update_manifest(root: str | Path, changes: dict) -> dict:
    return save_manifest(root, load_manifest(root) | changes)


def bootstrap_state(root: str | Path) -> str:
    """needed, declined or recorded."""
    state = load_manifest(root).get("bootstrap") or {}
    return "declined" if state.get("declined") else "recorded" if state.get("recorded") else "needed"


def bootstrap_decision(root: str | Path, decision: str) -> dict:
    if decision not in ("declined", "recorded"):
        raise ValueError(f"unknown decision {decision!r}")
    return update_manifest(root, {"bootstrap": {decision: True}})


def first_paragraph(markdown: str) -> str:
    """The first paragraph that is text: no heading, badge, quote or code."""
    for part in re.split(r"\n\s*\n", re.sub(r"(?s)```.*?```", "", markdown)):
        text = " ".join(part.split())
        if text and not re.match(r"[#>!\[<|-]", text):
            return text
    return ""


def skeleton(root: str | Path, most: int = 30) -> dict:
    """What a new workspace could start with: its README's first paragraph, manifests, folders and a paragraph for each."""
    base = Path(root)
    readme = next((p for p in sorted(base.glob("[Rr][Ee][Aa][Dd][Mm][Ee]*")) if p.is_file()), None)
    folders = sorted(p for p in base.iterdir() if p.is_dir() and not p.name.startswith(".") and p.name not in IGNORED)[:most]
    return {
        "summary": first_paragraph(readme.read_text("utf-8", "replace")) if readme else "",
        "manifests": [n for n in ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "Gemfile") if (base / n).is_file()],
        "folders": [{"name": f"{p.name}/", "text": folder_paragraph(p)} for p in folders],
    }


def folder_paragraph(folder: Path, most: int = 5) -> str:
    readme = next((p for p in sorted(folder.glob("[Rr][Ee][Aa][Dd][Mm][Ee]*")) if p.is_file()), None)
    if readme and (text := first_paragraph(readme.read_text("utf-8", "replace"))):
        return text
    files = sorted(p.name for p in folder.iterdir() if p.is_file() and not p.name.startswith("."))
    return f"{folder.name}: {', '.join(files[:most])}" if files else f"{folder.name}: no files"


# What asks for a push.
KEYWORDS = (
    "готово", "закоммить", "закоммитим", "закругляемся", "закрываем задачу", "закрыли", "запушил", "запуш", "задеплоил", "деплой", "доделал", "доделали", "закончил", "закончили", "мержим", "замержил", "завершил", "работа сделана", "шипим", "ок все", "готово к мёрджу",
    "ship", "ship it", "shipped", "merge", "merging", "merged", "commit this", "committed", "done", "we're done", "all done", "task complete", "completed", "wrap up", "wrapped", "closing this out", "pushed", "deployed", "pr is up", "pr opened", "lgtm", "that's it", "and we're done", "all set",
)
GIT_VERBS = ("git commit", "git push", "git merge", "git tag")
SLASH_COMMANDS = ("/commit", "/create-pr", "/ship", "/pr-review")


def triggers_push(text: str = "", command: str = "", slash: str = "") -> bool:
    return any(k in text.lower() for k in KEYWORDS) or command.strip().startswith(GIT_VERBS) or slash.strip() in SLASH_COMMANDS
