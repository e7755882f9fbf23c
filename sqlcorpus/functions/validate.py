"""Why a template is not accepted: the first rule it breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CurationConfig
from .quality import PARTS
from .text import I, S, W, strip

# Rejection messages.
EMPTY = "Empty SQL"
NO_PARAMS = "No parameters - not reusable"
TOO_SIMPLE = "Too simple - just SELECT * FROM table"
UNUSED = "Parameters defined but not used in SQL"
NO_DESCRIPTION = "No meaningful description"
LOW_SCORE = "Quality score too low"

_STAR = rf"{I}\A{S}*SELECT{S}+\*{S}+FROM{S}+[{W}]+{S}*;?{S}*\z"


def early_reason(statement: Column, original: Column, params: Column, question: Column, cfg: CurationConfig) -> Column:
    """The reason that rules a template out before it is scored, or null.

    Clean mode looks for the bare ``SELECT *`` in the original, since the template
    can no longer show it.
    """
    simple = (original if cfg.clean else statement).rlike(_STAR)
    return (
        F.when(strip(statement) == "", F.lit(EMPTY))
        .when(F.size(params) < 1, F.lit(NO_PARAMS))
        .when(simple, F.lit(TOO_SIMPLE))
        .when(~statement.rlike(rf"\{{\{{\.[{W}]+\}}\}}"), F.lit(UNUSED))
        .when(F.length(question) < 5, F.lit(NO_DESCRIPTION))
    )


def low_score_reason(score: Column, breakdown: Column) -> Column:
    template = f"{LOW_SCORE}: %.1f/100 (" + ", ".join(f"{p}=%.1f" for p in PARTS) + ")"
    return F.format_string(template, score, *[breakdown[p] for p in PARTS])
