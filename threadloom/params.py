"""Parameters that change results, and the fixed values of the two log formats."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

# The two log families, in their sort order, and how they are labelled. They are part
# of relative ids, block ids and rendered text, so they must not change.
SOURCE_A = "claude"
SOURCE_B = "codex"
LABELS = {SOURCE_A: "ClaudeCode", SOURCE_B: "Codex"}
SHORT_LABELS = {SOURCE_A: "cc", SOURCE_B: "cx"}

# The placeholder names are fixed values, the interface of user templates; the layout is free.
DEFAULT_TEMPLATE = """<!-- %BlockId% -->
### %Source%, %DateTime%

%Question%

**Reply of %Model%** (session %SessionId% %SessionName%, branch %GitBranch%, folder %Cwd%, version %Version%, tokens %Tokens%)

%Answer%

***
"""


@dataclass(frozen=True)
class Root:
    """One log directory. ``rank`` is its place in the list: the first root holding a file owns it."""

    directory: str
    source: str
    origin: str = "standard"  # standard | extra
    key: str = "std"
    suffix: str = ".jsonl"
    tree: bool | None = None  # search all levels; by default only family B is a tree

    @property
    def recursive(self) -> bool:
        return self.source == SOURCE_B if self.tree is None else self.tree

    @property
    def path(self) -> str:
        return self.directory.rstrip("/") or "/"

    @property
    def root_key(self) -> str:
        if self.origin == "extra" and self.key == "std":
            return hashlib.sha256(self.path.encode()).hexdigest()[:12]
        return self.key


@dataclass(frozen=True)
class Params:
    project: str
    extra_cwds: tuple[str, ...] = ()
    include_subdirectories: bool = True
    include_subagents_a: bool = True
    include_subagents_b: bool = True
    include_developer_messages: bool = False
    mode: str = "both"  # both | SOURCE_A | SOURCE_B
    template: str = DEFAULT_TEMPLATE
    # Prefix of the id in a block marker, as in "<!-- blockid:<24 hex> -->", and its placeholder.
    id_prefix: str = "blockid"
    id_placeholder: str = "BlockId"
    roots: tuple[Root, ...] = field(default_factory=tuple)

    @property
    def sources(self) -> tuple[str, ...]:
        return (SOURCE_A, SOURCE_B) if self.mode == "both" else (self.mode,)

    @property
    def wanted_cwds(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([self.project, *self.extra_cwds]))

    @property
    def wants_progress(self) -> bool:
        return "%Progress%" in self.template

    @property
    def wants_full_progress(self) -> bool:
        return "%ProgressFull%" in self.template

    def fingerprint(self) -> str:
        """Changes whenever a parameter changes; cached per-file results are dropped then."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()
