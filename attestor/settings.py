"""Settings of retrieval and answering, from a file of NAME=value lines and the environment, which goes first."""

from __future__ import annotations

import hashlib
import math
import os
import resource
import subprocess
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from attestor.operators.context import MIN_BUDGET
from attestor.sources.artifacts import canonical_hash

# What the settings may be.
TIERS, BACKENDS, MODES = ("full", "standard", "light", "minimal"), ("tfidf", "embeddings", "hybrid"), ("passages", "characters")
MAX_BUDGET, MOST_CANDIDATES, LEAST_CONTEXT_CANDIDATES = 16_000, 100, 40


@dataclass(frozen=True)
class Settings:
    retrieval_backend: str = "tfidf"
    retrieval_tier: str | None = None
    retrieval_reranker: str = "none"
    retrieval_rerank_candidates: int = 40
    retrieval_diversity: float = 0.0
    hybrid_lexical_weight: float = 1.0
    hybrid_embedding_weight: float = 1.0
    hybrid_candidates: int = 20
    hybrid_rrf_k: int = 60
    answer_context_mode: str = "passages"
    answer_context_chars: int = MAX_BUDGET
    answer_context_candidates: int = 40

    def __post_init__(self):
        weights = self.hybrid_lexical_weight, self.hybrid_embedding_weight
        within = lambda x, low, high: math.isfinite(x) and low <= x <= high
        reranked = self.retrieval_reranker != "none"
        rules = {
            "tier": self.retrieval_tier in (None, "auto", *TIERS), "backend": self.retrieval_backend in BACKENDS, "context mode": self.answer_context_mode in MODES,
            "context size": MIN_BUDGET <= self.answer_context_chars <= MAX_BUDGET, "context candidates": LEAST_CONTEXT_CANDIDATES <= self.answer_context_candidates <= MOST_CANDIDATES,
            "candidates of the reranker": 4 <= self.retrieval_rerank_candidates <= MOST_CANDIDATES, "weights": all(within(w, 0, 1) for w in weights) and sum(weights) > 0,
            "candidates of the hybrid": 1 <= self.hybrid_candidates <= MOST_CANDIDATES, "diversity": within(self.retrieval_diversity, 0, 1),
            "reranker over lexical hits": not (reranked and self.retrieval_backend == "tfidf"), "diversity without reranker": reranked or not self.retrieval_diversity,
            "reranked candidates for the context": not (reranked and self.answer_context_mode == "characters" and self.retrieval_rerank_candidates < self.answer_context_candidates),
        }
        if broken := [name for name, holds in rules.items() if not holds]:
            raise ValueError(f"settings out of bounds: {', '.join(broken)}")

    @staticmethod
    def load(path: str | Path | None = None, environment: Mapping[str, str] | None = None) -> Settings:
        """Every field from the variable of its name in capitals; blank ones keep the default."""
        values = (read_variables(path) if path else {}) | dict(os.environ if environment is None else environment)
        found = {}
        for f in fields(Settings):
            if text := (values.get(f.name.upper()) or "").strip():
                kind = {"int": int, "float": float}.get(f.type, str)
                try:
                    found[f.name] = kind(text)
                except ValueError:
                    raise ValueError(f"{f.name.upper()} is not a number") from None
        return Settings(**found)


def read_variables(path: str | Path) -> dict[str, str]:
    """NAME=value lines; ``#`` begins a comment, quotes around a value are dropped."""
    found = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            found[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return found


def retrieval_config_faults(declared: Mapping[str, object], artifact: Mapping[str, object]) -> list[str]:
    """Where a declared retrieval configuration differs from the artifact it is to be run on."""
    faults = []
    if declared.get("artifact_sha256") not in (None, canonical_hash(artifact)):
        faults.append("artifact_sha256")
    if declared.get("backend") in ("embeddings", "hybrid"):
        encoding = (artifact.get("embeddings") or {}).get("encoding")
        if encoding is None:
            return [*faults, "embeddings"]
        faults += [name for name, value in encoding.items() if name in declared and declared[name] != value]
    return faults


def provenance(root: str | Path) -> dict[str, object]:
    """Commit, whether files differ from it, and a hash of the package's sources; nulls where there is no repository."""
    root = Path(root)
    try:
        git = lambda *args: subprocess.check_output(["git", *args], cwd=root, text=True, stderr=subprocess.DEVNULL).strip()
        state = {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}
    except (OSError, subprocess.CalledProcessError):
        state = {"commit": None, "dirty": None}
    package = Path(__file__).parent
    sources = {str(p.relative_to(package)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(package.rglob("*.py"))}
    return state | {"sources_sha256": canonical_hash(sources)}


def peak_memory() -> int:
    """The driver process's greatest resident size so far, in bytes."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def frozen(contract: object, sha256: str) -> None:
    """Fail unless a contract is the one whose canonical hash was written down."""
    if canonical_hash(contract) != sha256:
        raise ValueError("the contract differs from the frozen one")
