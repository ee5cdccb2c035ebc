"""Who sent a text: the classification of incoming turns, queued commands and agent replies.

`kind` is one of owner, owner_mid_turn, owner_command, peer, task_notification, interrupt,
compact_summary, harness; the unified message kinds are owner, peer, agent and notification. Every rule is one
chain of `when`, evaluated in the order of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .normalize import KEY, ORDER, listed_at, once, origin, said_at, text_at

#: Texts that agents inject into a conversation.
INJECTED = ["<environment_context>", "<permissions instructions>", "<collaboration_mode>", "<skills_instructions>", "<app-context>", "# agents.md instructions", "========= memory_summary begins ========="]
KINDS = ["owner", "peer", "agent", "notification"]


def looks_injected(s: str | Column) -> Column:
    s = F.lower(F.col(s) if isinstance(s, str) else s)
    found = F.lit(False)
    for marker in INJECTED:
        found = found | F.contains(s, F.lit(marker))
    return found


def valid_tool_name(s: str | Column) -> Column:
    return (F.col(s) if isinstance(s, str) else s).rlike(r"\A[A-Za-z0-9_.:-]{1,64}\z")


def classify_texts(rows: DataFrame, text: str, owner: str = "owner", summary: Column | None = None, notified: Column | None = None, meta: Column | None = None, from_origin: bool = False, notifies: bool = True) -> DataFrame:
    """rows with kind, text, sender, handback, cmd_name and cmd_args of the column `text`.

    summary, notified and meta are flags that decide before the text does; with from_origin, so do the origin
    columns (see normalize.origin), of which kind task-notification counts if `notifies`. Without an origin, the
    text's opening tag decides; a text that opens with reminders is judged by what is left without them.
    Each step is a column of its own, so that no expression is evaluated twice.
    """
    no, none = F.lit(False), F.lit(None).cast("string")
    origin = F.when(F.col("has_origin"), F.coalesce("origin_kind", F.lit("?"))) if from_origin else none
    flags = F.when(summary if summary is not None else no, "compact_summary").when(notified if notified is not None else no, "notification")
    known = flags.when(origin == "human", "human").when((origin == "task-notification") & F.lit(notifies), "notification").when(origin == "peer", "origin_peer").when(origin.isNotNull(), "harness").when(meta if meta is not None else no, "harness")
    lead = lambda c: F.regexp_replace(c, r"(?U)\A\s+", "")
    begins = lambda *p: F.col("_lead").rlike(r"\A(?:" + "|".join(p) + ")")

    out = rows.withColumn("_raw", F.col(text)).withColumn("_known", known)
    reminded = (F.col("_known") == "human") | F.col("_known").isNull() & F.startswith(lead("_raw"), F.lit("<system-reminder>"))
    out = out.withColumn("_reminded", F.coalesce(reminded, no))
    out = out.withColumn("_body", F.when(F.col("_reminded"), T.strip(T.strip_reminders("_raw"))).otherwise(F.col("_raw")))
    out = out.withColumn("_lead", lead("_body")).withColumn("_name", F.when(begins("<command-name>"), T.tag("_lead", "command-name"))).withColumn("_args", F.when(begins("<command-name>"), T.tag("_lead", "command-args")))
    form = (
        F.when(F.col("_reminded") & (F.col("_body") == ""), "harness")
        .when(F.col("_known") == "human", "plain")
        .when(F.col("_known").isNotNull(), F.col("_known"))
        .when(F.col("_name").isNotNull() & F.col("_args").isNotNull(), "command")
        .when(begins("<local-command-caveat>", "<local-command-stdout>", "<local-command-stderr>", "<system-reminder>"), "harness")
        .when(begins(r"\[Request interrupted by user"), "interrupt")
        .when(begins("<task-notification>"), "notification")
        .when(begins("<cross-session-message", "<agent-message"), "peer")
        .otherwise("plain")
    )
    out = out.withColumn("_form", form)
    opening = r"(?s)\A.*?<(cross-session-message|agent-message)([^>]*)>(.*)\z"
    tagged = F.col("_form").isin("peer", "origin_peer") & F.col("_lead").rlike(opening)
    part = lambda i: F.when(tagged, F.regexp_extract("_lead", opening, i))
    out = out.withColumn("_tag", part(1)).withColumn("_attrs", part(2)).withColumn("_inner", T.strip(F.regexp_replace(T.strip(part(3)), r"(?s)(?:</(?:cross-session-message|agent-message)>\s*)+\z", "")))
    is_form = lambda *f: F.col("_form").isin(*f)
    kind = F.when(is_form("plain"), owner).when(is_form("command"), "owner_command").when(is_form("notification"), "task_notification").when(is_form("origin_peer"), "peer").otherwise(F.col("_form"))
    body = (
        F.when(is_form("plain"), T.unwrap_pasted(T.strip("_body")))
        .when(is_form("command"), F.when(F.col("_args") == "", F.col("_name")).otherwise(F.concat_ws(" ", "_name", "_args")))
        .when(is_form("notification", "interrupt"), T.strip("_raw"))
        .when(is_form("peer", "origin_peer"), F.coalesce(*([F.when(is_form("origin_peer"), T.strip("origin_body"))] if from_origin else []), "_inner", T.strip("_body")))
        .otherwise(F.col("_raw"))
    )
    sender = F.when(is_form("peer"), F.coalesce(T.attribute("_attrs", "name"), T.attribute("_attrs", "from")))
    handback = F.when(is_form("peer"), F.coalesce(F.col("_tag") == "agent-message", F.startswith("_lead", F.lit("<agent-message"))) | F.coalesce(F.startswith("_inner", F.lit("[Subagent hand-back]")), no))
    if from_origin:
        sender = sender.when(is_form("origin_peer"), F.col("origin_sender"))
        handback = handback.when(is_form("origin_peer"), F.col("origin_handback"))
    kept = [c for c in rows.columns if c not in (text, "kind", "text", "sender", "handback", "cmd_name", "cmd_args")]
    command = lambda c: F.when(is_form("command"), F.col(c))
    return out.select(*kept, kind.alias("kind"), body.alias("text"), sender.alias("sender"), F.coalesce(handback, no).alias("handback"), command("_name").alias("cmd_name"), command("_args").alias("cmd_args"))


def incoming(events: DataFrame, attachments: DataFrame, holding: str | None = None) -> DataFrame:
    """Every incoming text with its kind and delivery (turn or mid-turn); of a user turn, its first text block counts.
    With `holding`, only texts that hold this string as they were sent are classified."""
    # The first text block is found within its row: no shuffle brings a turn and its blocks together.
    said, blocks = said_at(), listed_at()
    is_text = F.transform(blocks, lambda b: F.coalesce(text_at("$.type", b) == "text", F.lit(False)))
    place = F.when(blocks.isNotNull(), F.array_position(is_text, F.lit(True)).cast("int") - 1).when(said.isNotNull(), 0)
    users = events.filter("type = 'user'").select(*KEY, "offset", "ts", "is_sidechain", "is_meta", "is_compact_summary", "v", once(place).alias("seq")).filter("seq >= 0")
    text = F.coalesce(text_at("$.text", F.get(blocks, F.col("seq"))), said)
    turns = users.select(*[c for c in users.columns if c != "v"], *origin("$.origin"), once(text).alias("text"))
    if holding is not None:
        turns, attachments = turns.filter(F.contains("text", F.lit(holding))), attachments.filter(F.contains("prompt", F.lit(holding)))
    own = classify_texts(turns, "text", "owner", summary=F.col("is_compact_summary"), meta=F.col("is_meta"), from_origin=True)
    queued = attachments.filter("attachment_type = 'queued_command' and prompt is not null").drop("text")
    told = classify_texts(queued.withColumn("ts", F.col("delivered_at")), "prompt", "owner_mid_turn", notified=F.coalesce(F.col("command_mode") == "task-notification", F.lit(False)), meta=F.col("attachment_is_meta"), from_origin=True, notifies=False)
    names = [*KEY, *ORDER, "ts", "is_sidechain", "delivery", "kind", "text", "sender", "handback", "cmd_name", "cmd_args"]
    return own.withColumn("delivery", F.lit("turn")).select(*names).unionByName(told.withColumn("delivery", F.lit("mid-turn")).select(*names))


def messages(incoming: DataFrame, blocks: DataFrame) -> DataFrame:
    """The unified stream: owner, peer and notification texts, and the agent's texts on the main chain."""
    kind = F.when(F.col("kind").isin("owner", "owner_mid_turn", "owner_command"), "owner").when(F.col("kind") == "peer", "peer").when(F.col("kind") == "task_notification", "notification")
    received = incoming.withColumn("kind", kind).filter("kind is not null").select(*KEY, *ORDER, "ts", "kind", "delivery", "sender", "handback", "text")
    said = blocks.filter("type = 'assistant' and block_type = 'text' and not is_sidechain and text is not null").select(*KEY, *ORDER, "ts", F.lit("agent").alias("kind"), F.lit(None).cast("string").alias("delivery"), F.lit(None).cast("string").alias("sender"), F.lit(False).alias("handback"), "text")
    return received.unionByName(said.filter(T.strip("text") != ""))
