"""Series hidden in the scripts of stored pages."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import constants as C
from tidemark.functions.numbers import token_value
from tidemark.functions.text import align, strip


def script_text(html: Column, markers: tuple[str, ...] = C.CHART_MARKERS) -> Column:
    """Bodies of the script elements that contain a marker, joined in page order."""
    bodies = F.regexp_extract_all(html, F.lit(C.SCRIPT_PATTERN), F.lit(1))

    def wanted(body: Column) -> Column:
        return reduce(or_, [F.contains(body, F.lit(m)) for m in markers])

    return F.array_join(F.filter(bodies, wanted), "")


#: A comment, a string with its escapes, a bracket or separator, or anything up to the next of these.
_TOKEN = re.compile(
    r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[\[\]{}(),:;]|[^\s\[\]{}(),:;"'`/]+|\S""", re.S
)
_CLOSES = {"]": "[", "}": "{", ")": "("}


class _Frame:
    """An open bracket: the values in it, and of an object what its keys of interest hold."""

    def __init__(self, bracket: str) -> None:
        self.bracket, self.key, self.text = bracket, None, []
        self.items: list[str] = []
        self.label: str | None = None
        self.data: list[str] | None = None
        self.place = 0


def _plain(text: list[str]) -> str:
    """The value that some tokens stand for; a string without its quotes and escapes."""
    if len(text) == 1 and text[0][:1] in "'\"`" and len(text[0]) > 1:
        return re.sub(r"(?s)\\(.)", r"\1", text[0][1:-1])
    return " ".join(text)


def chart_literals(js: str) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """The first list of labels in a script, and name and values of its datasets in order.

    The script is read once, token by token: brackets in strings and comments are text, and keys
    count only in the object that they stand in, in any order. Objects and lists among values are
    empty values. Without labelled datasets, those without a label are ``Dataset_1``, …
    """
    labels: list[str] | None = None
    found: list[tuple[int, str | None, list[str]]] = []
    stack = [_Frame("{")]

    def close_value() -> None:
        top = stack[-1]
        if top.bracket == "{" and top.key == "label" and top.text and top.label is None:
            top.label = _plain(top.text)
        elif top.bracket == "[" and top.text:
            top.items.append(_plain(top.text))
        top.key, top.text = None, []

    def close_frame(place: int) -> None:
        nonlocal labels
        close_value()
        done = stack.pop()
        top = stack[-1] if stack else _Frame("{")
        if done.data is not None:
            found.append((done.place, done.label, done.data))
        if done.bracket == "[" and top.bracket == "{" and not top.text:
            if top.key == "labels" and labels is None and done.items:
                labels = done.items
            elif top.key == "data" and len(stack) == 1:
                found.append((place, None, done.items))
            elif top.key == "data" and top.data is None:
                top.data, top.place = done.items, place
        elif top.bracket == "[" and not top.text:
            top.items.append("")
            return
        top.text.append("")

    before = token = ";"
    for match in _TOKEN.finditer(js):
        before, token, top = token, match.group(), stack[-1]
        if token.startswith(("//", "/*")):
            token = before
            continue
        if token in "[{(":
            stack.append(_Frame(token))
        elif token in _CLOSES:
            if any(f.bracket == _CLOSES[token] for f in stack[1:]):
                while stack[-1].bracket != _CLOSES[token]:
                    close_frame(match.start())
                close_frame(match.start())
        elif token in ",;":
            if top.bracket == "[" and before in "[,":
                top.items.append("")
            close_value()
        elif token == ":" and top.bracket == "{" and top.key is None:
            top.key, top.text = _plain(top.text[-1:]), []
        else:
            top.text.append(token)
    while stack:
        close_frame(len(js))
    found.sort(key=lambda f: f[0])
    named = [(name, data) for _, name, data in found if name is not None]
    return labels or [], named or [(f"Dataset_{i}", data) for i, (_, _, data) in enumerate(found, 1)]


_LITERALS = T.StructType([
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("sets", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("data", T.ArrayType(T.StringType())),
    ]))),
])


@F.pandas_udf(_LITERALS)
def _literals(scripts: pd.Series) -> pd.DataFrame:
    rows = [chart_literals(js or "") for js in scripts]
    sets = [[{"name": name, "data": data} for name, data in sets] for _, sets in rows]
    return pd.DataFrame({"labels": [labels for labels, _ in rows], "sets": sets})


def extract_series(
    pages: DataFrame, keys: list[str], html: str = "html",
    markers: tuple[str, ...] = C.CHART_MARKERS,
) -> DataFrame:
    """Rows ``(keys, Année, Mois, Valeur)`` of the chart literals of each page.

    Labels are the months, each dataset label is the year; see ``chart_literals``. Values are
    padded or cut to the labels. A page without labels gives no rows. Everything happens inside
    the row; no shuffle. Pages without a marker, nearly all, are left out before any script is read.
    """
    marked = reduce(or_, [F.contains(F.col(html), F.lit(m)) for m in markers])
    scripts = pages.where(marked).select(*keys, script_text(F.col(html), markers).alias("js__c"))
    read = scripts.select(*keys, _literals.asNondeterministic()("js__c").alias("read__c"))
    values = F.transform("set__c.data", lambda t: token_value(strip(t)))
    return (
        read.select(*keys, F.col("read__c.labels").alias("labels__c"), F.explode("read__c.sets").alias("set__c"))
        .where(F.size("labels__c") > 0)
        .select(
            *keys,
            F.col("set__c.name").alias(C.YEAR),
            F.inline(
                F.arrays_zip(
                    F.col("labels__c").alias(C.MONTH),
                    align(values, F.size("labels__c")).alias(C.RAW_VALUE),
                )
            ),
        )
    )
