"""What a run does."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    checksum: bool = False  # compare content hashes instead of lengths
    delete: bool = False
    yes: bool = False  # deletions are approved
    dry_run: bool = False
    whole_file: bool = False  # never send deltas
    hard_links: bool = False
    preserve: frozenset[str] = field(default_factory=lambda: frozenset({"mode", "mtime"}))  # of mode, mtime, owner, group
    verify: str = "none"  # none, changed or all
    tolerance_s: int | None = None  # how far times may differ in verification; None: not at all
    reserved: str = ".twinlake"  # the engine's own metadata below a root
    rules: tuple[str, ...] = ()  # "+ pattern" or "- pattern", first match wins
