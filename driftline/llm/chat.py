"""Chat formatting: layouts found by schema fingerprint, canonical turns, a reversible template with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn: trained turns (the assistant's) and all others.
TRAINED, OTHERS = ("<s>", "</s>"), ("[INST]", "[/INST]")
CONTROLS = [*TRAINED, *OTHERS]
TURNS = "array<struct<turn:bigint,role:string,text:string>>"

#: Turn number of a record's first turn: its field turn, or 0 where it has none.
_BASE = "CASE WHEN variant_get(v, '$.turn', 'variant') IS NULL THEN 0L ELSE try_variant_get(v, '$.turn', 'bigint') END"
#: Roles by other names.
_ROLE = "CASE {0} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {0} END"


def _listed(field: str, role: str, text: str, mapped: str) -> str:
    """SQL for the turns in a list of messages."""
    return f"transform(try_variant_get(v, '$.{field}', 'array<struct<{role} string, {text} string>>'), (m, i) -> named_struct('turn', {_BASE} + cast(i as bigint), 'role', {mapped.format('m.' + role)}, 'text', m.{text}))"


def _pair(asked: str, answer: str) -> str:
    """SQL for a question and its answer."""
    return f"array(named_struct('turn', {_BASE}, 'role', 'user', 'text', {asked}), named_struct('turn', {_BASE} + 1L, 'role', 'assistant', 'text', {answer}))"


def _get(field: str) -> str:
    return f"try_variant_get(v, '$.{field}', 'string')"


#: Declarative mappings, the first that applies counts: the nested field paths that a layout needs, and SQL over the
#: record ``v`` for its turns. A record may have further fields; an empty list has no paths to miss.
LAYOUTS = {
    "messages": (["messages[].content", "messages[].role"], _listed("messages", "role", "content", "{}")),
    "shared": (["conversations[].from", "conversations[].value"], _listed("conversations", "from", "value", _ROLE)),
    "turn_row": (["role", "text"], f"array(named_struct('turn', {_BASE}, 'role', {_get('role')}, 'text', {_get('text')}))"),
    "instruction_input": (["input", "instruction", "output"], _pair(f"concat_ws('\\n', {_get('instruction')}, nullif({_get('input')}, ''))", _get("output"))),
    "instruction": (["instruction", "output"], _pair(_get("instruction"), _get("output"))),
    "prompt": (["prompt", "response"], _pair(_get("prompt"), _get("response"))),
    "completion": (["completion", "prompt"], _pair(_get("prompt"), _get("completion"))),
}


def _has(path: str) -> str:
    """SQL: the record ``v`` has a field at this path; in a list one element that has it, or none at all."""
    head, _, inner = path.partition("[].")
    if not inner:
        return f"variant_get(v, '$.{head}', 'variant') IS NOT NULL"
    items = f"try_variant_get(v, '$.{head}', 'array<variant>')"
    return f"variant_get(v, '$.{head}', 'variant') IS NOT NULL AND coalesce(exists({items}, m -> variant_get(m, '$.{inner}', 'variant') IS NOT NULL) OR size({items}) = 0, false)"


def fingerprint(paths: list[str]) -> Column:
    """A hash of those of the nested field paths that the record ``v`` has; further fields, types and values don't
    matter."""
    found = F.filter(F.array(*[F.when(F.expr(_has(p)), F.lit(p)) for p in sorted(paths)]), lambda p: p.isNotNull())
    return F.xxhash64(F.array_join(found, "\n"))


def canonical_turns(records: DataFrame, record: str, layouts: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """Add layout and turns for a variant column; both are null where no mapping's fingerprint is the record's."""
    known = LAYOUTS if layouts is None else layouts
    df = records.withColumn("v", F.col(f"`{record}`"))
    prints = {name: fingerprint(paths) == F.xxhash64(F.lit("\n".join(sorted(paths)))) for name, (paths, _) in known.items()}
    layout = F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in prints.items()])
    df = df.withColumn("layout", layout)
    turns = F.coalesce(*[F.when(F.col("layout") == name, F.expr(mapping).cast(TURNS)) for name, (_, mapping) in known.items()])
    return df.withColumn("turns", turns).drop("v")


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of every control string."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add formatted and loss_spans (start and length in code points of each assistant text, as escaped)."""
    trained = lambda t: F.coalesce(t["role"] == "assistant", F.lit(False))
    head = lambda t: F.concat(F.when(trained(t), TRAINED[0]).otherwise(OTHERS[0]), escape_role(t["role"]), F.lit("\n"))
    parts = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), F.when(trained(t), TRAINED[1]).otherwise(OTHERS[1]).alias("end"), trained(t).alias("loss")))
    df = df.withColumn("__parts", parts)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, p: F.struct((a["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["end"])).alias("at"), F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"))
    return df.withColumns({"formatted": F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], p["end"])), ""), "loss_spans": F.aggregate("__parts", start, step, lambda a: a["spans"])}).drop("__parts")


def read_back(df: DataFrame, formatted: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Add back_turns (role, text), parsed from the formatted text, and loss_texts, cut out by the loss mask."""
    pieces = F.filter(F.split(F.col(formatted), r"(?<=</s>|\[/INST\])"), lambda p: p != "")
    body = lambda p: F.regexp_replace(p, r"(?s)^(?:<s>|\[INST\])|(?:</s>|\[/INST\])$", "")
    name = r"[^\\\n]*+(?:\\.[^\\\n]*+)*+"
    role, text = rf"(?s)^({name})\n.*$", rf"(?s)^{name}\n(.*)$"
    parsed = F.transform(F.transform(pieces, body), lambda p: F.struct(unescape(F.regexp_extract(p, role, 1)).alias("role"), unescape(F.regexp_extract(p, text, 1)).alias("text")))
    cut = F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), s["start"] + 1, s["length"])))
    return df.withColumns({"back_turns": parsed, "loss_texts": cut})


def gather_conversations(rows: DataFrame, key: str, record: str) -> DataFrame:
    """One row per key: its turns in order (turn, then role, then text; nulls first) from one or more records, and
    unmapped, the number of records whose layout is not known and which so have no turns.

    Rows whose key is null form one conversation. A conversation is one value, so it has to fit in a row; records are
    mapped before they are gathered, and all conversations but the largest share a task with others.
    """
    df = canonical_turns(rows.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{record}`").alias("__record")), "__record")
    return df.groupBy("__key").agg(F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"), F.count_if(F.col("turns").isNull()).alias("unmapped")).withColumnRenamed("__key", key)


def format_records(rows: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """Format the conversations of a table of variant records in any of the LAYOUTS: key, turns, unmapped, formatted
    (all turns by the template), loss_spans, and what is read back from these, back_turns and loss_texts.

    Null and empty texts and roles are empty; texts of any length are kept whole; equal turns and repeated rows are
    turns of their own; other columns, whatever their names, are ignored; an empty table gives an empty one.
    """
    return read_back(format_turns(gather_conversations(rows, key, record)))


def format_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``format_records`` for a table of one turn a row (key, turn, role, text)."""
    record = F.to_variant_object(F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))
    return format_records(rows.select(F.col(f"`{key}`"), record.alias("record")), key)
