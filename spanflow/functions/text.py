"""Text classification and code building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Window-title fragments that identify the editor, tried in this
# order; the first rule with a matching fragment wins, anything else is "other".
EDITOR_RULES: list[tuple[list[str], str]] = [
    (["- Eclipse", "- Spring Tool Suite"], "eclipse"),
    (["- Visual Studio Code"], "vscode"),
    (["- NetBeans"], "netbeans"),
    (["- Sublime Text"], "sublime text"),
    (["- Notepad++"], "notepad++"),
]
EDITOR_DEFAULT = "other"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_contains(col, rules: list[tuple[list[str], str]], default: str) -> Column:
    """First-match classification: the label of the first rule whose fragments
    the text contains; ``default`` when none matches (and for null text)."""
    c = _col(col)
    expr = None
    for fragments, label in rules:
        cond = reduce(lambda a, b: a | b, [c.contains(f) for f in fragments])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def classify_editor(app_col) -> Column:
    return classify_contains(app_col, EDITOR_RULES, EDITOR_DEFAULT)


def composite_key(*cols, sep: str = " - ", null_value: str = "mouse", null_col=None) -> Column:
    """``null_value`` when ``null_col`` (default: the last column) is null,
    else the columns joined with ``sep``."""
    cs = [_col(c) for c in cols]
    test = _col(null_col) if null_col is not None else cs[-1]
    return F.when(test.isNull(), F.lit(null_value)).otherwise(F.concat_ws(sep, *cs))


def event_token(event_col, kind_col, up: str = "up", down: str = "down") -> Column:
    """Event code with its press/release suffix: ``<event>U`` for up,
    ``<event>D`` for down, the bare code otherwise (null event -> null)."""
    e, k = _col(event_col), _col(kind_col)
    return (F.when(k == up, F.concat(e, F.lit("U")))
             .when(k == down, F.concat(e, F.lit("D")))
             .otherwise(e))
