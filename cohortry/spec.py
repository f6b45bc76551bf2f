"""Run parameters, the window vocabulary and the structured error."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

# Characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Role of a column in this library -> its name in the raw all-string panel.
RAW_COLUMNS: Mapping[str, str] = {
    "entity": "ncodpers",
    "snapshot": "fecha_dato",
    "acquired": "fecha_alta",
    "seniority": "antiguedad",
    "is_new": "ind_nuevo",
    "age": "age",
    "income": "renta",
    "segment": "segmento",
    "channel": "canal_entrada",
    "province_code": "cod_prov",
    "province": "nomprov",
    "country": "pais_residencia",
    "resident": "indresi",
    "foreign": "indext",
    "is_active": "ind_actividad_cliente",
    "employee": "ind_empleado",
    "relation": "indrel",
    "relation_type": "tiprel_1mes",
    "flag": "ind_tjcr_fin_ult1",
}


@dataclass(frozen=True)
class PanelSpec:
    """One panel: its observation window, and the names of its raw columns.

    ``white_space`` is what padding may consist of: a panel known to be padded with blanks only is
    cleaned faster with ``" "``. ``panel_start`` and ``panel_end`` are first-of-month dates; the same pair decides cohort
    membership and censoring. ``max_age`` is the last age (in months) of a vintage curve.
    """

    panel_start: dt.date
    panel_end: dt.date
    max_age: int = 17
    observe_months: int = 6
    white_space: str = WHITE_SPACE
    raw: Mapping[str, str] = field(default_factory=lambda: dict(RAW_COLUMNS))

    def __post_init__(self) -> None:
        if self.panel_end < self.panel_start:
            raise ValueError("panel_end lies before panel_start")
        missing = set(RAW_COLUMNS) - set(self.raw)
        if missing:
            raise ValueError(f"raw column names missing for: {sorted(missing)}")


class Window(str, Enum):
    """Where in the customer's life a metric is read."""

    MSA_3 = "msa_3"
    MSA_6 = "msa_6"
    MSA_12 = "msa_12"
    RET_1M = "ret_1m"
    RET_2M = "ret_2m"
    RET_3M = "ret_3m"
    ACQUIRED_TO_ADOPTED = "acquired_to_adopted"
    ADOPTED_TO_RETAINED = "adopted_to_retained"
    LIFETIME = "lifetime"

    @property
    def age(self) -> int:
        """Months since acquisition at which an ``msa_*`` window reads the curve."""
        if not self.value.startswith("msa_"):
            raise ValueError(f"{self.value} has no age")
        return int(self.value.removeprefix("msa_"))

    @property
    def retention_column(self) -> str:
        """Cohort summary column that a ``ret_*`` window reads."""
        if not self.value.startswith("ret_"):
            raise ValueError(f"{self.value} is not a retention window")
        return "retention_rate_" + self.value.removeprefix("ret_")


class MetricError(Exception):
    """A refused metric call: a stable ``code`` for programs, a ``message`` for people."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message

    def as_dict(self) -> dict:
        return {"error": {"code": self.code, "message": self.message}}
