"""Column roles and the fixed values of the candidate-registry domain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# --- fixed values: column lists -------------------------------------------
IDENTIFIER_COLUMNS = [
    "NR_CPF_CANDIDATO", "NM_CANDIDATO", "NM_SOCIAL_CANDIDATO",
    "NR_TITULO_ELEITORAL_CANDIDATO", "SQ_CANDIDATO", "NM_EMAIL",
    "NR_PROCESSO", "NR_CANDIDATO", "NM_URNA_CANDIDATO",
]
BASE_COLUMNS = [
    "SG_UF", "NM_UE", "CD_CARGO", "NR_PARTIDO", "SG_PARTIDO", "CD_GENERO",
    "CD_GRAU_INSTRUCAO", "CD_ESTADO_CIVIL", "CD_COR_RACA", "CD_OCUPACAO",
    "FAIXA_ETARIA", "DS_SITUACAO_CANDIDATURA", "DS_SIT_TOT_TURNO",
]
# --- fixed values: sentinels, labels, titles ------------------------------
TEXT_SENTINELS = ["-1", "-3", "#NULO", "#NE", "NÃO DIVULGÁVEL"]
NUMBER_SENTINELS = [-1, -3]
NULL_TOKEN = "NULL"
REST_TOKEN = "OUTROS_GRUPOS"
SHORT_REST_TOKEN = "OUTROS"
NO_SOURCE_TOKEN = "NAO_INFORMADO"
TITLES = [
    "PASTOR", "BISPO", "PADRE", "IRMÃO", "IRMÃ", "PROFESSOR", "PROF",
    "DOUTOR", "DR", "DRA", "CORONEL", "COL", "SARGENTO", "SGT", "DELEGADO",
]
# --- fixed values: generation bins (low, high], label ---------------------
GENERATION_BINS = [
    (0, 1960, "BOOMER"),
    (1960, 1975, "GEN_X"),
    (1975, 1985, "MILLENNIAL_FALDA"),
    (1985, 1995, "MILLENNIAL_NOVO"),
    (1995, 2005, "GEN_Z"),
    (2005, 2026, "NEW_GEN"),
]


@dataclass(frozen=True)
class Strategy:
    """Top-N limits of one generalisation profile."""

    name: str
    default_limit: int
    limits: dict[str, int] = field(default_factory=dict)
    skip: tuple[str, ...] = ()
    exact_year: bool = False

    def limit_of(self, column: str) -> int:
        return self.limits.get(column, self.default_limit)


# --- fixed values: top-N limits per profile -------------------------------
STRATEGIES = {
    "high_fidelity": Strategy(
        "high_fidelity", 100, {"SG_PARTIDO": 45}, skip=("NM_UE", "CD_OCUPACAO"), exact_year=True,
    ),
    "minimal": Strategy("minimal", 40, {"NM_UE": 500, "CD_OCUPACAO": 100, "FAIXA_ETARIA": 15}),
    "intensive": Strategy(
        "intensive", 10,
        {"NM_UE": 50, "CD_OCUPACAO": 10, "SG_PARTIDO": 30, "NR_PARTIDO": 30, "FAIXA_ETARIA": 6},
    ),
}


def strategy(name: str | Strategy) -> Strategy:
    """A profile by name; unknown names mean ``intensive``."""
    if isinstance(name, Strategy):
        return name
    return STRATEGIES.get(name, STRATEGIES["intensive"])


@dataclass(frozen=True)
class Roles:
    """What each column of a record table is for.

    ``row_id`` orders rows repeatably. ``aux`` are the quasi-identifiers an
    attacker knows; linkability needs them in two disjoint parts, which default
    to the two halves of ``aux``.
    """

    row_id: str
    aux: tuple[str, ...]
    secret: str
    target: str
    identifiers: tuple[str, ...] = tuple(IDENTIFIER_COLUMNS)
    base: tuple[str, ...] = tuple(BASE_COLUMNS)
    birth_date: str = "DT_NASCIMENTO"
    aux_a: tuple[str, ...] = ()
    aux_b: tuple[str, ...] = ()

    def linked_parts(self) -> tuple[list[str], list[str]]:
        if self.aux_a and self.aux_b:
            return list(self.aux_a), list(self.aux_b)
        half = len(self.aux) // 2
        return list(self.aux[:half]), list(self.aux[half:])


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail early, by name, when a role column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
