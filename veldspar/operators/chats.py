"""Conversations: rolling context, compaction, memories, branches, feedback, tools and skills."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import arithmetic
from veldspar.functions.text import compact, strip, token_set, tokens, word_cut

MESSAGES, MEMORIES, MEMORY_CHARS, SUMMARY_CHARS = 12, 40, 3000, 3000

# When a message calls for a tool.
TOOL_TRIGGERS: dict[str, tuple[str, ...]] = {
    "calculator": (r"(?i)\b(calculate|math|sum|plus|minus|times|divided|=)\b", r"\d+\s*[-+*/^]\s*\d+"),
    "list_files": (r"(?i)\b(list|show|what).*\b(files|documents|uploads)\b",),
    "file_stats": (r"(?i)\b(stats|statistics|how many|count).*\b(files|chunks|documents)\b",),
    "time": (r"(?i)\b(time|date|today|now)\b",),
}
# How follow-up questions begin.
FOLLOW_UPS = ("and ", "what about", "how about", "then ", "also ", "compare", "same for")


def rolling_context(messages: DataFrame, notes: DataFrame | None = None, keep: int = MESSAGES) -> DataFrame:
    """The last ``keep`` messages of each chat, after one system row of its memory and summary if it has either.

    ``messages`` (chat_id, pos, role, content), ``notes`` (chat_id, memory, summary). The system row has position -1.
    """
    order = Window.partitionBy("chat_id").orderBy(F.desc("pos"))
    last = messages.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).select("chat_id", "pos", "role", "content")
    if notes is None:
        return last
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label + ":\n"), F.col(c)))
    text = F.concat_ws("\n\n", part("Saved chat memory", "memory"), part("Earlier conversation summary", "summary"))
    head = notes.select("chat_id", F.lit(-1).cast(messages.schema["pos"].dataType).alias("pos"), F.lit("system").alias("role"), text.alias("content"))
    return last.unionByName(head.filter("content <> ''"))


def compact_chats(messages: DataFrame, keep: int = MESSAGES) -> DataFrame:
    """Fold what is older than the last ``keep`` messages into a summary: chat_id, folded, summary.

    Each folded message is one line of at most 240 characters; of the summary the last 3000 stay. Chats
    with nothing to fold have no row.
    """
    order = Window.partitionBy("chat_id").orderBy(F.desc("pos"))
    old = messages.withColumn("r", F.row_number().over(order)).filter(F.col("r") > max(0, keep))
    line = strip(F.translate("content", "\n", " "))
    line = F.when(F.length(line) > 240, F.concat(word_cut(line, 240), F.lit("..."))).otherwise(line)
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.col("role"), F.lit(": "), line).alias("line"))))
    text = strip(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"))
    return old.groupBy("chat_id").agg(F.count(F.lit(1)).alias("folded"), F.right(text, F.lit(SUMMARY_CHARS)).alias("summary"))


def memory_block(memories: DataFrame, items: int = MEMORIES, chars: int = MEMORY_CHARS) -> DataFrame:
    """The last ``items`` memories of each chat as lines, up to the first that would exceed ``chars``: chat_id, lines, memory."""
    newest = Window.partitionBy("chat_id").orderBy(F.desc("pos"))
    last = memories.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= items)
    line = F.concat(F.lit("- "), strip(F.col("content")))
    so_far = F.sum(F.length("line")).over(Window.partitionBy("chat_id").orderBy("pos"))
    kept = last.withColumn("line", line).withColumn("used", so_far).filter(F.col("used") <= chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("chat_id").agg(F.count(F.lit(1)).alias("lines"), joined.alias("memory"))


# What states a fact about the user.
REMEMBER = r"(?i)\bremember(?: that)? ([^.?!]+)"
MY = r"(?i)\bmy ([a-zA-Z][a-zA-Z0-9_ -]{1,40}) is ([^.?!]+)"
MY_WHOLE = r"(?i)\Amy ([a-zA-Z][a-zA-Z0-9_ -]{1,40}) is (.+)"
PREFER = r"(?i)\bi prefer ([^.?!]+)"
CALL_ME = r"(?i)\bcall me ([^.?!]+)"


def _memories(text: Column) -> Column:
    """Facts a message states about its user, in canonical form, distinct."""
    trim_marks = lambda c: F.regexp_replace(F.regexp_replace(c, r"\A[ ,;:]+", ""), r"[ ,;:]+\z", "")
    part = lambda m, pattern, k: strip(F.regexp_extract(m, pattern, k))
    all_ = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    owned = lambda m, pattern: F.concat(F.lit("User's "), part(m, pattern, 1), F.lit(" is "), part(m, pattern, 2))
    fact = lambda c: F.when(c.rlike(MY_WHOLE), owned(c, MY_WHOLE)).otherwise(c)
    found = F.concat(
        F.transform(all_(REMEMBER), lambda m: fact(part(m, REMEMBER, 1))),
        F.transform(all_(MY), lambda m: owned(m, MY)),
        F.transform(all_(PREFER), lambda m: F.concat(F.lit("User prefers "), part(m, PREFER, 1))),
        F.transform(all_(CALL_ME), lambda m: F.concat(F.lit("User wants to be called "), part(m, CALL_ME, 1))),
    )
    plain = F.filter(F.transform(found, trim_marks), lambda c: F.length(c) >= 4)
    return F.array_distinct(F.transform(plain, lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))))


def extract_memories(messages: DataFrame) -> DataFrame:
    """Memories that user messages state: chat_id, pos, item, memory."""
    users = messages.filter("role = 'user'")
    return users.select("chat_id", "pos", F.posexplode(_memories(compact(F.col("content")))).alias("item", "memory"))


def upsert_memories(memories: DataFrame, items: int = MEMORIES) -> DataFrame:
    """Memories in the order in which they were first said, each in its latest wording; the last ``items`` stay.

    ``memories`` (chat_id, ord, content): wordings alike in their tokens are one memory.
    """
    key = F.array_join(tokens(F.col("content")), " ")
    one = memories.withColumn("key", key).filter("key <> ''").groupBy("chat_id", "key").agg(
        F.min("ord").alias("first"), F.max_by(strip(F.col("content")), "ord").alias("content")
    )
    order = Window.partitionBy("chat_id").orderBy(F.desc("first"))
    return one.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= items).select("chat_id", F.col("first").alias("pos"), "content")


def prune_branch(messages: DataFrame, targets: DataFrame, include: bool = False) -> DataFrame:
    """Messages of each chat before (or up to) the position named in ``targets`` (chat_id, target_pos)."""
    both = messages.join(targets, "chat_id")
    keep = F.col("pos") <= F.col("target_pos") if include else F.col("pos") < F.col("target_pos")
    return both.filter(keep).drop("target_pos")


def rerun(messages: DataFrame, targets: DataFrame, edits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chats cut before the user message at ``targets`` (chat_id, target_pos), and that message as the question to ask again: chat_id, content.

    ``edits`` (chat_id, content) are new wordings of it. A target that is no user message asks nothing and leaves its chat whole.
    """
    at = targets.select(F.col("chat_id").alias("own"), F.col("target_pos").alias("cut"))
    asked = messages.join(at, (F.col("chat_id") == F.col("own")) & (F.col("pos") == F.col("cut")) & (F.col("role") == "user")).select("chat_id", "cut", "content")
    kept = messages.join(asked.select(F.col("chat_id").alias("own"), "cut"), F.col("chat_id") == F.col("own"), "left").filter("cut is null or pos < cut").select(*messages.columns)
    if edits is None:
        return kept, asked.select("chat_id", "content")
    new = edits.select(F.col("chat_id").alias("own"), F.col("content").alias("edited"))
    return kept, asked.join(new, F.col("chat_id") == F.col("own"), "left").select("chat_id", F.coalesce("edited", "content").alias("content"))


def regenerate(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats without their last turn, and its question, where the last two messages are the user's and an answer; other chats stay whole."""
    order = Window.partitionBy("chat_id").orderBy(F.desc("pos"))
    last = messages.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    turns = last.groupBy("chat_id").agg(F.max_by("role", "r").alias("first"), F.min_by("role", "r").alias("second"), F.min("pos").alias("target_pos"), F.count(F.lit(1)).alias("n"))
    return rerun(messages, turns.filter("n = 2 and first = 'user' and second = 'assistant'").select("chat_id", "target_pos"))


def previous_question(messages: DataFrame) -> DataFrame:
    """Each assistant message with the nearest user message before it, empty if there is none: chat_id, pos, question."""
    before = Window.partitionBy("chat_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)
    return messages.withColumn("question", F.coalesce(asked, F.lit(""))).filter("role = 'assistant'").select("chat_id", "pos", "question")


def review_feedback(rated: DataFrame, rating: str | None = None, tag: str | None = None, limit: int = 100) -> DataFrame:
    """Rated answers, the latest first, with the total before the limit.

    ``rated`` has message_id, rating, tags, updated_at.
    """
    rows = rated.filter(F.col("rating").isNotNull())
    if rating is not None:
        rows = rows.filter(F.col("rating") == rating)
    if tag is not None:
        rows = rows.filter(F.array_contains("tags", " ".join(tag.lower().split())))
    total = rows.agg(F.count(F.lit(1))).first()[0]
    return rows.orderBy(F.desc("updated_at"), "message_id").limit(limit).withColumn("total", F.lit(total))


def is_follow_up(message: Column) -> Column:
    text = strip(F.lower(message))
    short = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")) <= 5
    opens = F.lit(False)
    for start in FOLLOW_UPS:
        opens = opens | text.startswith(start)
    return short | opens


def plan_queries(messages: DataFrame, most: int = 3) -> DataFrame:
    """Queries planned for each user message from what its chat said before: chat_id, pos, plan_pos, query.

    A follow-up puts the system hint and the last user turn before itself; else the message comes first. Then come the last
    two user turns with it, and the hint with it. White space is compacted, repeats go, ``most`` stay.
    """
    order = Window.partitionBy("chat_id").orderBy("pos")
    notes = F.collect_list(F.when(F.col("role") == "system", F.col("content"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Of the user's turns only the last two count.
    at = messages.withColumn("systems", notes).filter("role = 'user'").withColumn("last", F.lag("content").over(order)).withColumn("former", F.lag("content", 2).over(order))
    raw = F.array_join(F.filter(F.transform("systems", strip), lambda s: s != ""), "\n\n")
    label = "Earlier conversation summary:"
    swapped = F.when(
        F.contains(raw, F.lit(label)),
        F.concat(F.lit(label + " "), F.substring(raw, F.instr(raw, label) + len(label), F.lit(1 << 30)), F.lit(" "), F.left(raw, F.instr(raw, label) - 1)),
    ).otherwise(raw)
    hint = compact(swapped)
    hint = F.when(F.length(hint) > 500, F.regexp_replace(F.right(hint, F.lit(500)), r"\A[^ ]* ", "")).otherwise(hint)
    at = at.withColumn("hint", hint).withColumn("follow", is_follow_up(F.col("content")))
    line = lambda *parts: F.concat_ws("\n", *parts)
    told = F.col("last").isNotNull()
    hinted = F.col("hint") != ""
    planned = F.array_compact(
        F.array(
            F.when(F.col("follow") & hinted, line(F.col("hint"), F.col("content"))),
            F.when(F.col("follow") & told, line(F.col("last"), F.col("content"))),
            F.col("content"),
            F.when(told, line(F.col("former"), F.col("last"), F.col("content"))),
            F.when(hinted, line(F.col("hint"), F.col("content"))),
        )
    )
    short = F.slice(F.array_distinct(F.filter(F.transform(planned, compact), lambda q: q != "")), 1, most)
    return at.select("chat_id", "pos", F.posexplode(short).alias("plan_pos", "query"))


def tool_triggers(messages: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``tools``: the tools that each message calls for."""
    hit = []
    for tool, patterns in TOOL_TRIGGERS.items():
        on = F.lit(False)
        for p in patterns:
            on = on | F.col(content).rlike(p)
        hit.append(F.when(on, F.lit(tool)))
    return messages.withColumn("tools", F.array_compact(F.array(*hit)))


#: What tools do: from a message's text to what they tell; those that need tables are run by their own operators.
TOOLS: dict[str, Callable[[Column], Column]] = {
    "calculator": arithmetic.calculate,
    "time": lambda content: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
}


def register_tool(name: str, patterns: Sequence[str], run: Callable[[Column], Column]) -> None:
    """Add a tool that messages call for by any of ``patterns``."""
    TOOL_TRIGGERS[name] = tuple(patterns)
    TOOLS[name] = run


def run_tools(selected: DataFrame, content: str = "content") -> DataFrame:
    """What the selected tools of each message (query_id, content, tools) tell: query_id, ord, name, output; a tool that finds nothing tells nothing."""
    told = [F.struct(F.lit(i).alias("ord"), F.lit(t).alias("name"), F.when(F.array_contains("tools", t), run(F.col(content))).alias("output")) for i, t in enumerate(TOOL_TRIGGERS) if (run := TOOLS.get(t))]
    each = selected.select("query_id", F.explode(F.filter(F.array(*told), lambda x: x["output"].isNotNull())).alias("t"))
    order = Window.partitionBy("query_id").orderBy("t.ord")
    return each.select("query_id", (F.row_number().over(order) - 1).alias("ord"), "t.name", "t.output")


def select_tools(triggered: DataFrame, requested: Sequence[str] | None = None, forced: Sequence[str] = ()) -> DataFrame:
    """Tools that run: the forced ones, and those requested or else triggered; unknown names are an error."""
    unknown = sorted({*(requested or ()), *forced} - TOOL_TRIGGERS.keys())
    if unknown:
        raise ValueError(f"unknown tools: {', '.join(unknown)}")
    base = F.col("tools") if not requested else F.array(*[F.lit(t) for t in requested])
    always = F.array(*[F.lit(t) for t in forced]) if forced else F.expr("cast(array() as array<string>)")
    order = list(TOOL_TRIGGERS)
    chosen = F.array_union(always, base)
    return triggered.withColumn("tools", F.filter(F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains(chosen, t)))


def match_skills(messages: DataFrame, skills: DataFrame, content: str = "content", chosen: DataFrame | None = None) -> DataFrame:
    """Enabled skills one of whose triggers stands in a message, and those chosen for it: chat_id, pos, skill_id.

    ``skills`` (skill_id, enabled, triggers) is a small table of definitions: all of them go to each message as one row, whatever their
    number, and only those that match come of it. ``chosen`` (chat_id, pos, skill_id) adds enabled skills that a request names.
    """
    active = skills.filter("enabled").select("skill_id", F.filter(F.transform("triggers", lambda t: F.trim(F.lower(t))), lambda t: t != "").alias("triggers"))
    one = active.agg(F.collect_list(F.struct("skill_id", "triggers")).alias("skills"))
    said = messages.select("chat_id", "pos", F.lower(F.col(content)).alias("said")).join(F.broadcast(one), how="cross")  # one row
    hit = F.filter("skills", lambda s: F.exists(s["triggers"], lambda t: F.contains("said", t)))
    found = said.select("chat_id", "pos", F.explode(F.transform(hit, lambda s: s["skill_id"])).alias("skill_id"))
    if chosen is None:
        return found
    named = chosen.join(active.select("skill_id"), "skill_id", "left_semi").select("chat_id", "pos", "skill_id")
    return found.unionByName(named).distinct()


def context_suggestions(current: DataFrame, suggested: DataFrame, replace: bool = False) -> DataFrame:
    """File scopes with suggestions applied: chat_id, file_ids (in order, without repeats), added (those that are new)."""
    both = current.join(suggested, "chat_id", "full_outer")
    none = F.expr("cast(array() as array<bigint>)")
    have, new = F.coalesce("file_ids", none), F.coalesce("suggested_ids", none)
    result = F.array_distinct(new) if replace else F.array_distinct(F.concat(have, new))
    return both.select("chat_id", result.alias("file_ids"), F.array_except(new, have).alias("added"))


def prefer(explicit: Column, default: Column, fallback: object) -> Column:
    """A request's own field, else its chat's default, else the schema's."""
    return F.coalesce(explicit, default, F.lit(fallback))


def shared_terms(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(token_set(left), token_set(right)))
