"""The registry of commands: names, checks, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sheets import write_sheets
from . import policy

ARGUMENT_TYPES = ("str", "int", "enum")
HOSTS = ("login_server", "target_server")
RESERVED = ("user_id",)


def guess_column(columns: list[str], words: list[str]) -> str:
    """The first column whose lower-case name holds one of the words; empty if none does."""
    return next((c for c in columns if any(w in c.lower() for w in words)), "")


def base_name(title: Column, command: Column) -> Column:
    """An ASCII name: the first two words of the title, else of the command, else a fixed hash."""
    def words(t: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), r"\{[^}]*\}", " "), r"[^A-Za-z0-9_]+", " ")
        kept = F.filter(F.split(plain, r"\s+", -1), lambda w: (w != "") & ~w.rlike(r"^[0-9]+$"))
        return F.nullif(F.lower(F.array_join(F.slice(kept, 1, 2), "_")), F.lit(""))

    name = F.coalesce(words(title), words(command), F.concat(F.lit("k"), F.substring(F.sha1(F.coalesce(title, F.lit(""))), 1, 6)))
    return F.substring(F.when(name.rlike("^[a-z]"), name).otherwise(F.concat(F.lit("c_"), name)), 1, 60)


def tool_names(commands: DataFrame, taken: DataFrame) -> DataFrame:
    """commands (title, exec_command) with tool_name: its base name, or that with the next free number from 2.

    Rows of one base name are numbered in order of title after those taken.
    """
    named = commands.withColumn("__base", base_name(F.col("title"), F.col("exec_command")))
    numbered = F.regexp_extract("tool_name", r"^(.*?)(?:_([0-9]+))?$", 1)
    used = taken.select("tool_name", F.explode(F.array_distinct(F.array("tool_name", numbered))).alias("__base"), F.coalesce(F.regexp_extract("tool_name", r"_([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("k"))
    top = used.groupBy("__base").agg(F.max(F.when(F.col("tool_name") == F.col("__base"), 1).otherwise(F.col("k"))).alias("__top"))
    n = F.row_number().over(Window.partitionBy("__base").orderBy("title")) + F.coalesce("__top", F.lit(0))
    out = named.join(top, "__base", "left").withColumn("__n", n)
    return out.withColumn("tool_name", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat(F.substring("__base", 1, 57), F.lit("_"), F.col("__n").cast("string")))).drop("__base", "__top", "__n")


def definition_problem(name: Column, command: Column, arguments: Column, host: Column) -> Column:
    """Why a definition is refused: name, host, denied, argument, reserved, duplicate, type, choices, missing or unused; null if it is sound.

    arguments: array of (name, type, choices).
    """
    names = F.transform(arguments, lambda a: F.btrim(F.coalesce(a["name"], F.lit(""))))
    used = F.filter(policy.placeholders(command), lambda p: ~p.isin(*RESERVED))
    return (
        F.when(~F.coalesce(name, F.lit("")).rlike("^[a-z][a-z0-9_]*$"), "name")
        .when(~host.isin(*HOSTS), "host")
        .when(policy.denied(F.split(command, r"\s+", -1), True).isNotNull(), "denied")
        .when(F.exists(names, lambda n: ~n.rlike("^[a-z][a-z0-9_]*$")), "argument")
        .when(F.exists(names, lambda n: n.isin(*RESERVED)), "reserved")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate")
        .when(F.exists(arguments, lambda a: ~F.coalesce(a["type"], F.lit("str")).isin(*ARGUMENT_TYPES)), "type")
        .when(F.exists(arguments, lambda a: (a["type"] == "enum") & (F.size(F.filter(F.coalesce(a["choices"], F.array().cast("array<string>")), lambda c: F.btrim(c) != "")) < 1)), "choices")
        .when(F.size(F.array_except(used, names)) > 0, "missing")
        .when(F.size(F.array_except(names, used)) > 0, "unused")
    )


def merge_catalogs(have: DataFrame, *catalogs: DataFrame) -> DataFrame:
    """Entries (title, description, exec_command) of several catalogs that the registry lacks, the first catalog first.

    Titles are trimmed, blank ones go; a blank command is the title; a command
    that is not ASCII comes in disabled.
    """
    rows = None
    for k, c in enumerate(catalogs):
        part = c.select(F.btrim("title").alias("title"), F.btrim(F.coalesce("description", F.lit(""))).alias("description"), F.btrim(F.coalesce("exec_command", F.lit(""))).alias("exec_command"), F.lit(k).alias("__k"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.filter("title <> ''").groupBy("title").agg(F.min(F.struct("__k", "description", "exec_command")).alias("r"))
    new = first.join(have.select("title"), "title", "left_anti")
    command = F.coalesce(F.nullif("r.exec_command", F.lit("")), F.col("title"))
    return new.select("title", F.col("r.description").alias("description"), command.alias("exec_command"), (~command.rlike(r"[^\x00-\x7f]")).alias("enabled"))


def bulk(rows: DataFrame, arguments: Column) -> DataFrame:
    """Uploaded commands (row_no, tool_name, exec_command, host_mode) with their problem; sound ones have none."""
    return rows.withColumn("arguments", arguments).withColumn("problem", definition_problem(F.col("tool_name"), F.col("exec_command"), F.col("arguments"), F.col("host_mode")))


#: Headings and labels of the form in which commands are exported and uploaded again.
BASE_HEADINGS = ("이름", "설명", "실행 커맨드", "실행 위치", "활성", "필요 역할")
ARGUMENT_HEADINGS = ("이름", "설명", "타입", "필수", "기본값", "선택지")
TYPE_LABELS = {"str": "문자열", "int": "정수", "enum": "선택형"}
HOST_LABELS = {"login_server": "로그인 서버", "target_server": "대상 서버"}
ROLES = ("admin", "user")


def command_rows(commands: DataFrame, slots: int = 4) -> DataFrame:
    """Commands as rows of the form: six columns, then six for each of the first ``slots`` arguments.

    commands: title, description, exec_command, host_mode, enabled,
    required_roles (array), args (array of name, description, type, required,
    default, choices). Nulls are empty cells; an unknown or missing type is
    text, a missing host the login server, any other but it the target; an
    unused slot has the labels of text and of not required.
    """
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))
    yes = lambda c: F.when(c, "Y").otherwise("N")
    host = F.coalesce(F.nullif("host_mode", F.lit("")), F.lit("login_server"))
    cells = [text(F.col("title")), text(F.col("description")), text(F.col("exec_command")), F.when(host == "login_server", HOST_LABELS["login_server"]).otherwise(HOST_LABELS["target_server"]), yes(F.col("enabled")), F.array_join(F.coalesce("required_roles", empty), ", ")]
    names = list(BASE_HEADINGS)
    for k in range(slots):
        a = F.get("args", F.lit(k))
        kind = F.when(a["type"] == "int", TYPE_LABELS["int"]).when(a["type"] == "enum", TYPE_LABELS["enum"]).otherwise(TYPE_LABELS["str"])
        cells += [text(a["name"]), text(a["description"]), kind, yes(a["required"]), text(a["default"]), F.array_join(F.coalesce(a["choices"], empty), "\n")]
        names += [f"인자{k + 1} {h}" for h in ARGUMENT_HEADINGS]
    return commands.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)])


def form_lists(columns: list[str]) -> tuple[dict[str, list[str]], tuple[str, ...]]:
    """Drop-down lists of the form's columns, and the columns that also take other values."""
    lists = {"타입": list(TYPE_LABELS.values()), "필수": ["Y", "N"], "활성": ["Y", "N"], "실행 위치": list(HOST_LABELS.values()), "필요 역할": ["", *ROLES]}
    field = {c: c.split(" ", 1)[-1] if c.startswith("인자") else c for c in columns}
    return {c: lists[f] for c, f in field.items() if f in lists}, tuple(c for c, f in field.items() if f == "필요 역할")


def export_commands(commands: DataFrame, path: str, slots: int = 4, mode: str = "overwrite") -> None:
    """Workbooks of the form under ``path``, in order of title, with its drop-down lists."""
    rows = command_rows(commands, slots)
    lists, free = form_lists(rows.columns)
    write_sheets(rows.orderBy(F.col(f"`{BASE_HEADINGS[0]}`")), path, lists, free, sheet="커맨드", mode=mode)


def edit_records(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Records after edits (id, question, answer): an edited one loses its label and vector."""
    e = edits.select("id", F.col("question").alias("__q"), F.col("answer").alias("__a"), F.lit(True).alias("__e"))
    out = records.join(e, "id", "left")
    clear = {c: F.when(F.col("__e"), F.lit(None).cast(records.schema[c].dataType)).otherwise(F.col(c)) for c in ("handled_by", "embedding") if c in records.columns}
    return out.withColumns({"question": F.coalesce("__q", "question"), "answer": F.coalesce("__a", "answer"), **clear}).select(*records.columns)


def audit(user: Column, tool: Column, params: Column, status: Column, result: Column, request: Column) -> Column:
    """One audit row as a struct; parameters and result as JSON."""
    return F.struct(tool.alias("tool_name"), F.to_json(params).alias("params"), user.alias("requested_by"), status.alias("status"), F.to_json(result).alias("result"), request.alias("request_id"))
