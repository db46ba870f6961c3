"""Writers: stage tables as JSON arrays, report tables as Markdown, LaTeX and CSV, and the documents composed of them.

Report tables are small by nature (a row for each class, run or threshold; lists are cut to a stated number of rows), so their
text is made of rows by columns functions and only the finished lines of one table come to the driver.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fixed


def write_json(table: DataFrame, path: str) -> None:
    """A stage's table as JSON lines in a folder, by all tasks."""
    table.write.mode("overwrite").json(path)


def write_json_array(table: DataFrame, path: str, order: list[str]) -> int:
    """A small table as one JSON array in a file, rows in `order`. The rows are streamed, not held; returns their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in table.orderBy(*order).select(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            f.write((",\n " if n else "\n ") + row["j"])
            n += 1
        f.write("\n]\n")
    return n


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def markdown_row(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(_shown, columns)), F.lit(" |"))


def latex_row(columns: list[str]) -> Column:
    """Cells with underscores and percent signs escaped, heads stay as they are."""
    cells = [F.replace(F.replace(_shown(c), F.lit("_"), F.lit("\\_")), F.lit("%"), F.lit("\\%")) for c in columns]
    return F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\"))


def csv_row(columns: list[str]) -> Column:
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *map(cell, columns))


@dataclass
class ReportTable:
    """A named, captioned table: `rows` with the columns of `header` (column: head), in the order of the `order` columns."""

    name: str
    caption: str
    header: dict[str, str]
    rows: DataFrame
    order: tuple[str, ...] = ()

    def lines(self, row: Column) -> list[str]:
        rows = self.rows.orderBy(*self.order) if self.order else self.rows
        return [r["line"] for r in rows.select(row.alias("line")).collect()]

    def markdown(self) -> str:
        heads = list(self.header.values())
        return "\n".join(["| " + " | ".join(heads) + " |", "|" + "---|" * len(heads), *self.lines(markdown_row(list(self.header)))])

    def latex(self) -> str:
        begin = ["\\begin{table}[htbp]", "\\centering", f"\\caption{{{self.caption}}}", f"\\begin{{tabular}}{{{'l' * len(self.header)}}}", "\\hline"]
        return "\n".join([*begin, " & ".join(self.header.values()) + " \\\\", "\\hline", *self.lines(latex_row(list(self.header))), "\\hline", "\\end{tabular}", "\\end{table}"])

    def csv(self) -> str:
        return "\r\n".join([",".join(self.header.values()), *self.lines(csv_row(list(self.header)))]) + "\r\n"

    def write(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for suffix, text in (("md", f"**{self.caption}**\n\n{self.markdown()}\n"), ("tex", self.latex()), ("csv", self.csv())):
            with open(os.path.join(folder, f"{self.name}.{suffix}"), "w", encoding="utf-8", newline="") as f:
                f.write(text)


def report(tables: list[ReportTable], providers: list[str] = [], notes: list[str] = []) -> str:
    """One page of all tables by the number in their names (t3_overall is table 3), with the backends that answered."""
    number = lambda t: int(t.name.split("_")[0][1:])
    lines = ["# Results", "", f"Detection backends: {', '.join(sorted(providers)) or 'n/a'}.", ""]
    if list(providers) == ["mock"]:
        lines += ["> The `mock` backend is a set of rules, not a language model: these numbers say what the structure gives without one.", ""]
    for t in sorted(tables, key=number):
        lines += [f"## Table {number(t)} — {t.caption}", "", t.markdown(), ""]
    return "\n".join([*lines, *(f"> {n}" for n in notes)])


def site_lines(sites: DataFrame, most: int = 25) -> DataFrame:
    """The lines of a prevention document: class_id, sites, section (a class's place by falling number of sites), line_no, line.

    Sites: class_id, title, category, mitigation, mitigation_title, actions, patch, protocol, file, line, function, score, ordinal.
    A class lists its best `most` sites, and how many more there are. Classes with as many sites keep the order of their best site.
    """
    key = F.struct((-F.col("score")).alias("s"), "ordinal")
    ranked = sites.withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("score"), "ordinal")))
    heads = sites.groupBy("class_id").agg(F.count(F.lit(1)).alias("sites"), F.min(key).alias("_best"), F.first(F.struct("title", "category", "mitigation", "mitigation_title", "actions", "patch")).alias("h"))
    heads = heads.withColumn("section", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("sites"), "_best"))).drop("_best")  # a row for each class
    top = F.array(
        F.concat(F.lit("## "), "class_id", F.lit(" — "), "h.title"),
        F.concat(F.lit("*Category:* "), "h.category", F.lit(" · *Mitigation:* "), "h.mitigation", F.lit(" — "), "h.mitigation_title"),
        F.lit(""),
        F.lit("**Actions**"),
    )
    rest = F.array(F.lit(""), F.lit("**Patch template**"), F.lit("```solidity"), F.col("h.patch"), F.lit("```"), F.lit(""), F.concat(F.lit("**Affected sites ("), F.col("sites").cast("string"), F.lit(")**")), F.lit(""))
    before = heads.select("class_id", "sites", "section", F.posexplode(F.concat(top, F.transform("h.actions", lambda a: F.concat(F.lit("- "), a)), rest)).alias("line_no", "line"))
    site = F.format_string("- `%s` %s:%d → `%s` (score %s)", "protocol", "file", "line", "function", fixed(F.col("score"), 3))
    listed = ranked.where(F.col("place") <= most).join(heads.select("class_id", "sites", "section"), "class_id").select("class_id", "sites", "section", (F.col("place") + 10_000).alias("line_no"), site.alias("line"))
    more = heads.where(F.col("sites") > most).select("class_id", "sites", "section", F.lit(99_999).alias("line_no"), F.format_string("- ...and %d more", F.col("sites") - most).alias("line"))
    return before.unionByName(listed).unionByName(more)


def prevention_document(sites: DataFrame, precision: float | None = None, most: int = 25) -> str:
    """The whole document, with what was measured about the detector at its top. At most `most` sites of each class come to the driver."""
    lines = site_lines(sites, most).orderBy("section", "line_no").collect()
    measured = f" Measured precision of this run: **{precision:.3f}**." if isinstance(precision, int | float) else ""
    head = [
        "# Prevention report", "", f"Detector outputs requiring review: **{sites.count()}**", "",
        f"> These are unverified outputs of a detector, not confirmed defects.{measured} Each site needs a manual review; control protocols are listed by construction.", "",
    ]
    return "\n".join([*head, *(r["line"] for r in lines)])


def trace_document(step: dict) -> str:
    """One decision, block by block: the slice, what was retrieved and confirmed, prompts, replies and the verdict. Values are texts."""
    rule = "=" * 78
    return "\n".join(line for title, body in step.items() for line in (rule, f"  {title}", rule, "", str(body).rstrip(), ""))
