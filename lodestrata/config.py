"""Settings, the department allowlist, and the constants that results depend on."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

import yaml

# They decide results and must be as they are.
RRF_K = 60
K_PER_BRANCH = 25
POOL = 25
FINAL_K = 6
RERANK_FLOOR = 0.2
MIN_TOKENS, MAX_TOKENS = 100, 800
BREADCRUMB_SLACK = 4
STUB_CHARS = 200
ERROR_CHARS = 2000
PROMPT_VERSION = "answer_v1"
MAX_ANSWER_TOKENS = 2048
NOT_FOUND = "I couldn't find an answer to this in the knowledge base you have access to."
CONTENT_ROOT = "content/handbook"
DEPARTMENTS = ["company", "engineering", "security", "people-group", "finance", "legal", "sales", "marketing", "product"]
FOLDERS = {
    "company": "company",
    "engineering": "engineering",
    "security": "security",
    "people-group": "people-group",
    "people-policies": "people-group",
    "total-rewards": "people-group",
    "finance": "finance",
    "legal": "legal",
    "sales": "sales",
    "marketing": "marketing",
    "product": "product",
    "product-development": "product",
}
GRANTS = {
    "engineer": ["engineering", "security", "company"],
    "hr_partner": ["people-group", "company"],
    "finance_analyst": ["finance", "company"],
    "legal_counsel": ["legal", "people-group", "company"],
    "exec": DEPARTMENTS,
}
USERS = {
    "eng@example.com": "engineer",
    "hr@example.com": "hr_partner",
    "finance@example.com": "finance_analyst",
    "legal@example.com": "legal_counsel",
    "exec@example.com": "exec",
}


@dataclass(frozen=True)
class Allowlist:
    """Departments, and the top-level folders that belong to each; folders outside are not walked."""

    departments: tuple[str, ...] = tuple(DEPARTMENTS)
    folders: dict[str, str] = field(default_factory=lambda: dict(FOLDERS))

    def __post_init__(self) -> None:
        doubled = sorted({d for d in self.departments if self.departments.count(d) > 1})
        if doubled:
            raise ValueError(f"departments given more than once: {doubled}")
        unknown = {f: d for f, d in self.folders.items() if d not in self.departments}
        if unknown:
            raise ValueError(f"folders of unknown departments: {unknown}")

    @property
    def allowed_folders(self) -> list[str]:
        return sorted(self.folders)

    def allows(self, folder: str) -> bool:
        return folder in self.folders

    def department_of(self, folder: str) -> str | None:
        return self.folders.get(folder)

    def require(self, departments: list[str] | None) -> list[str] | None:
        """The departments asked for; an unknown one is an error rather than an empty walk."""
        unknown = sorted(set(departments or ()) - set(self.departments))
        if unknown:
            raise ValueError(f"unknown departments: {unknown}; known: {list(self.departments)}")
        return departments


def load_allowlist(path: str | None = None) -> Allowlist:
    """From a YAML file with ``departments`` and ``folder_to_department``; without a path, the built-in one."""
    if path is None:
        return Allowlist()
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    return Allowlist(tuple(found.get("departments") or ()), dict(found.get("folder_to_department") or {}))


@dataclass(frozen=True)
class Settings:
    """What a run can be told; ``from_env`` reads ``LODESTRATA_<NAME>``."""

    k_per_branch: int = K_PER_BRANCH
    pool: int = POOL
    final_k: int = FINAL_K
    rerank_floor: float = RERANK_FLOOR
    min_tokens: int = MIN_TOKENS
    max_tokens: int = MAX_TOKENS
    embed_batch: int = 64
    embed_retries: int = 3
    #: The path of a rank file of byte-pair tokens that workers can read; without one token counts are approximate.
    vocabulary: str | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.min_tokens <= self.max_tokens or self.max_tokens < 1:
            raise ValueError("0 <= min_tokens <= max_tokens, and max_tokens >= 1")
        if min(self.k_per_branch, self.pool, self.final_k, self.embed_batch, self.embed_retries) < 1:
            raise ValueError("sizes and retries are at least 1")
        if not 0 <= self.rerank_floor <= 1:
            raise ValueError("rerank_floor is between 0 and 1")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f"LODESTRATA_{f.name.upper()}")
            if raw is not None:
                given[f.name] = {"float": float, "int": int}.get(f.type, str)(raw)
        return cls(**given)
