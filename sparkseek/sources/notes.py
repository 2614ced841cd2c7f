"""Markdown notes handed to reasoning backends: shared contract, skill packs and operator hints."""

from __future__ import annotations

from pathlib import Path

from .. import fixed_values as fv

CONTRACT_NAMES = ("CONTRACT.md", "00-CONTRACT.md")


def load_folder(folder: str | Path, extra=()) -> list[str]:
    """Texts of a notes folder: the contract first, then the other files by name, then the extra files."""
    base = Path(folder)
    files = sorted(base.glob("*.md")) if base.is_dir() else []
    contract = [f for name in CONTRACT_NAMES for f in files if f.name == name][:1]
    others = [f for f in files if f.name.upper() not in {n.upper() for n in CONTRACT_NAMES}]
    return [f.read_text(encoding="utf-8") for f in [*contract, *others, *(Path(e) for e in extra if Path(e).exists())]]


def pack_notes(folder: str | Path, packs) -> str:
    """Text of the named context packs; a note that was seen before is left out."""
    names = {name: parts for name, *_, parts in fv.CONTEXT_PACKS}
    files = sorted(Path(folder).glob("*.md")) if Path(folder).is_dir() else []
    chosen: dict[str, None] = {}
    for pack in packs:
        for file in files:
            if any(part in file.name.lower() for part in names[pack]):
                chosen[file.read_text(encoding="utf-8")] = None
    return "\n\n".join(chosen)
