"""Registered queries: conversation logs."""

from pyspark.sql import functions as F

from passagework import constants as K
from passagework.operators import chatlog as H
from passagework.plans.catalog import Tables, query
from passagework.plans.sqltext import strip

# Sessions are the conversations; every third has been renamed, some were touched later.
SESSIONS = """sessions AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'renamed ' || conv_id ELSE '新对话' END AS title,
  conv_id AS created_at, CASE WHEN conv_id % 4 > 0 THEN conv_id * 2 END AS updated_at,
  CASE WHEN conv_id % 5 > 1 THEN 'so far ' || conv_id WHEN conv_id % 5 = 1 THEN '' END AS summary
  FROM (SELECT DISTINCT conv_id FROM conversations))"""


def sessions(t: Tables):
    conv = F.col("conv_id")
    number = conv.cast("string")
    return t.conversations.select("conv_id").distinct().select(
        "conv_id",
        F.when(conv % 3 == 0, F.concat(F.lit("renamed "), number)).otherwise(K.DEFAULT_TITLE).alias("title"),
        conv.alias("created_at"),
        F.when(conv % 4 > 0, conv * 2).alias("updated_at"),
        F.when(conv % 5 > 1, F.concat(F.lit("so far "), number)).when(conv % 5 == 1, "").alias("summary"),
    )


@query("session_list", f"""
WITH {SESSIONS} SELECT s.conv_id, title, coalesce(updated_at, created_at) AS touched, count(m.conv_id) AS message_count
FROM sessions s LEFT JOIN (SELECT conv_id FROM conversations) m USING (conv_id) GROUP BY ALL
""")
def session_list(t: Tables):
    out = H.session_list(sessions(t), t.conversations)
    return out.select("conv_id", "title", F.coalesce("updated_at", "created_at").alias("touched"), "message_count")


@query("session_page", """
SELECT conv_id, turn, role, md5(text) AS text_md5, n > 3 AS has_more FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE turn < 6) WHERE age <= 3
""")
def session_page(t: Tables):
    out = H.session_page(t.conversations, 3, F.lit(6))
    return out.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "has_more")


@query("keep_last_n", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 4
""")
def keep_last_n(t: Tables):
    return H.keep_last(t.conversations, 4).select("conv_id", "turn", "role")


@query("trim_history", """
WITH m AS (SELECT *, greatest(1, length(text) * 2 // 5) AS tok, first(role) OVER w = 'system' AND turn = min(turn) OVER (PARTITION BY conv_id) AS front,
    CASE WHEN first(role) OVER w = 'system' THEN first(greatest(1, length(text) * 2 // 5)) OVER w ELSE 0 END AS head
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, sum(tok) OVER v AS spent, coalesce(sum((role = 'user')::int) OVER (PARTITION BY conv_id ORDER BY turn DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rounds FROM m WHERE NOT front WINDOW v AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn, role FROM b WHERE spent + head <= 400 AND rounds < 2 UNION ALL SELECT conv_id, turn, role FROM m WHERE front
""")
def trim_history(t: Tables):
    return H.trim_history(t.conversations, 400, 2).select("conv_id", "turn", "role")


@query("auto_title", f"""
WITH {SESSIONS}, f AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CASE WHEN title = '新对话' THEN coalesce(nullif(substr(replace({strip('text')}, chr(10), ' '), 1, 10), ''), '新对话') ELSE title END AS title
FROM sessions LEFT JOIN f USING (conv_id)
""")
def auto_title(t: Tables):
    return H.auto_title(t.conversations, sessions(t)).select("conv_id", "title")


@query("last_user_question", "SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_question(t: Tables):
    return H.last_question(t.conversations)


FLAGGED = """flagged AS (SELECT *, CASE WHEN turn = 0 AND length(text) % 2 = 0 THEN true WHEN turn % 3 = 0 THEN false END AS summarized FROM conversations)"""


def flagged(t: Tables):
    done = F.when((F.col("turn") == 0) & (F.length("text") % 2 == 0), True).when(F.col("turn") % 3 == 0, False)
    return t.conversations.withColumn("summarized", done)


DUE = f"""{FLAGGED}, waiting AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
  count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS users FROM flagged WHERE NOT coalesce(summarized, false)),
due AS (SELECT * FROM waiting WHERE users > 1 AND place <= users - 1)"""


def due(t: Tables):
    return H.summarize_due(flagged(t), 1, 1, block=4)


@query("summarize_due", f"WITH {DUE} SELECT conv_id, turn, role FROM due")
def summarize_due(t: Tables):
    return due(t).select("conv_id", "turn", "role")


NEW_TEXT = """n AS (SELECT conv_id, substr(string_agg(CASE role WHEN 'user' THEN '用户' ELSE 'AI' END || ': ' || substr(text, 1, 2000), chr(10) ORDER BY turn), 1, 500) AS new_text
  FROM due GROUP BY 1)"""


@query("summary_text", f"""
WITH {DUE}, {SESSIONS}, {NEW_TEXT}
SELECT conv_id, CASE WHEN coalesce(summary, '') <> '' THEN summary || chr(10) || '[早期对话]' || chr(10) || new_text ELSE new_text END AS summary
FROM n JOIN sessions USING (conv_id)
""")
def summary_text(t: Tables):
    return H.summary_texts(due(t), sessions(t))


@query("mark_summarized", f"""
WITH {DUE} SELECT f.conv_id, f.turn, d.turn IS NOT NULL OR coalesce(f.summarized, false) AS summarized
FROM flagged f LEFT JOIN due d ON d.conv_id = f.conv_id AND d.turn = f.turn
""")
def mark_summarized(t: Tables):
    return H.mark_summarized(flagged(t), due(t)).select("conv_id", "turn", "summarized")


@query("inject_summary", f"""
WITH {SESSIONS}, lead AS (SELECT conv_id, min(turn) AS first_turn, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1),
x AS (SELECT conv_id, first_turn, first_role, CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || chr(10) || '[对话历史摘要]' || chr(10) || summary ELSE '' END AS extra
  FROM lead JOIN sessions USING (conv_id))
SELECT conv_id, turn, role, text || CASE WHEN role = 'system' AND turn = first_turn THEN extra ELSE '' END AS text FROM conversations JOIN x USING (conv_id)
UNION ALL SELECT conv_id, first_turn - 1, 'system', 'Be brief.' || extra FROM x WHERE first_role <> 'system'
""")
def inject_summary(t: Tables):
    return H.inject_summary(t.conversations, sessions(t).select("conv_id", "summary"), prompt="Be brief.")


@query("answered_flag", "SELECT conv_id, arg_max(role, turn) = 'assistant' AS answered FROM conversations GROUP BY 1")
def answered_flag(t: Tables):
    return H.answered_flag(t.conversations)


def exchanges(t: Tables):
    asked = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    given = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return given.join(asked, ["conv_id", "turn"]).withColumnRenamed("turn", "ts")


@query("append_turns", """
WITH p AS (SELECT a.conv_id, a.turn AS ts, q.text AS question, a.text AS answer FROM conversations a JOIN conversations q
  ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant' AND q.role = 'user'),
m AS (SELECT conv_id, max(ts) AS updated_at FROM p GROUP BY 1)
SELECT conv_id, ts, 'user' AS role, substr(question, 1, 300) AS text, updated_at FROM p JOIN m USING (conv_id)
UNION ALL SELECT conv_id, ts, 'assistant', substr(answer, 1, 300), updated_at FROM p JOIN m USING (conv_id)
""")
def append_turns(t: Tables):
    rows, touched = H.append_turns(exchanges(t), 300)
    return rows.drop("part").join(touched, "conv_id")
