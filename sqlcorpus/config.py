"""Job settings. One frozen value is passed to every plan builder."""

from __future__ import annotations

from dataclasses import dataclass, replace

COMPAT = "compat"
CLEAN = "clean"

DIALECTS = ("mysql", "postgres", "sqlite", "sql_server")

# Accepted dialect spellings; anything else means mysql.
DIALECT_ALIASES = {
    "mysql": "mysql",
    "postgres": "postgres",
    "postgresql": "postgres",
    "sqlite": "sqlite",
    "sql_server": "sql_server",
    "mssql": "sql_server",
}


def dialect_of(name: str) -> str:
    """Canonical dialect name for a user's spelling."""
    return DIALECT_ALIASES.get(name.lower(), "mysql")


@dataclass(frozen=True)
class CurationConfig:
    """Settings of one curation run.

    ``mode`` is ``compat`` (established output, quirks included) or ``clean``
    (quirks that corrupt a statement are put right). The two differ in a few
    regular expressions and flags, never in the shape of the plan.
    """

    mode: str = COMPAT
    use_parameterization: bool = True
    use_quality_scoring: bool = True
    use_labeling: bool = True
    parameterize_tables: bool = True
    parameterize_columns: bool = True
    min_params: int = 1
    min_quality_score: float = 50.0
    max_quality_score: float = 100.0
    dialect: str = "mysql"
    kind: str = "mysql-sql"
    source_name: str = "mysql"
    double_quotes: str = "literal"
    key_digits: int | None = None
    apply_threshold: bool | None = None

    def __post_init__(self) -> None:
        if self.mode not in (COMPAT, CLEAN):
            raise ValueError(f"mode must be {COMPAT!r} or {CLEAN!r}, not {self.mode!r}")
        if self.double_quotes not in ("literal", "identifier"):
            raise ValueError("double_quotes must be 'literal' or 'identifier'")

    @property
    def clean(self) -> bool:
        return self.mode == CLEAN

    @property
    def digits(self) -> int:
        """Length of the hash suffix of a tool key: 16 bits in compat, 64 in clean."""
        return self.key_digits or (16 if self.clean else 4)

    @property
    def viewer_threshold(self) -> bool:
        """Whether the viewer layout drops tools below the minimum score."""
        return self.clean if self.apply_threshold is None else self.apply_threshold

    def but(self, **changes) -> "CurationConfig":
        return replace(self, **changes)
