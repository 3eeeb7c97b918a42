"""Small prompts with known results: each rule, region kind and scanner fires in one at least.

``◊`` stands for a value of the row, ``⟦ ⟧`` for the stretch that is to be found. The
expected results are written down by hand, so SQL can state them without the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (rule, prompt, rewritten)
RULES = (
    ("politeness.please", "Please open ◊ now.", "Open ◊ now."),
    ("frame.polite-request", "Could you open ◊ now?", "Open ◊ now?"),
    ("frame.task-is-to", "Your task is to open ◊.", "Open ◊."),
    ("frame.you-are-asked-to", "You are asked to open ◊.", "Open ◊."),
    ("intensifier.degree", "Open a very big ◊.", "Open a big ◊."),
    ("hedge.opinion", "Say so: i believe the ◊ works.", "Say so: the ◊ works."),
    ("frame.as-an-ai", "So as an AI assistant, open ◊.", "So open ◊."),
    ("frame.important-to-note", "It is important to note that the ◊ works.", "The ◊ works."),
    ("frame.in-this-task", "In this task, open ◊.", "Open ◊."),
    ("frame.the-following-is", "Then the following is a ◊.", "Then ◊."),
    ("sub.in-order-to", "Go in order to ◊.", "Go to ◊."),
    ("sub.for-the-purpose-of", "Kept for the purpose of ◊.", "Kept for ◊."),
    ("sub.because", "Stop due to the fact that ◊ failed.", "Stop because ◊ failed."),
    ("sub.if", "Stop in the event that ◊ fails.", "Stop if ◊ fails."),
    ("sub.now", "Stop at this point in time, ◊.", "Stop now, ◊."),
    ("sub.about", "Ask with regard to ◊.", "Ask about ◊."),
    ("sub.many", "Open a large number of ◊ rows.", "Open many ◊ rows."),
    ("sub.most", "Open the majority of ◊ rows.", "Open most ◊ rows."),
    ("sub.although", "Go on despite the fact that ◊ failed.", "Go on although ◊ failed."),
    ("sub.can", "It is able to ◊.", "It can ◊."),
    ("sub.use", "Now make use of ◊.", "Now use ◊."),
    ("sub.utilize", "Now utilized ◊.", "Now used ◊."),
    ("sub.utilization", "See utilization of ◊.", "See use of ◊."),
    ("sub.before", "Stop prior to ◊.", "Stop before ◊."),
    ("sub.consider", "Now take into account ◊.", "Now consider ◊."),
    ("sub.help", "Now provide assistance with ◊.", "Now help with ◊."),
    ("sub.start", "Now commence ◊.", "Now start ◊."),
    ("sub.then", "And subsequently ◊.", "And then ◊."),
    ("ws.trailing-space", "Open ◊  \nnext", "Open ◊\nnext"),
    ("ws.repeated-space", "Open   the ◊.", "Open the ◊."),
    ("ws.blank-lines", "Open ◊\n\n\n\nnext", "Open ◊\n\nnext"),
    ("ws.nbsp", "Open the ◊.", "Open the ◊."),
    ("ws.space-before-punct", "Open ◊ , then stop", "Open ◊, then stop"),
    ("md.bullet-marker", "* open ◊", "- open ◊"),
    ("md.bullet-space", "  -   open ◊", "  - open ◊"),
    ("md.ordered-space", "  1.   open ◊", "  1. open ◊"),
    ("punct.apostrophe", "Don’t open ◊.", "Don't open ◊."),
)

# (kind, prompt)
REGIONS = (
    ("code-fence", "Run\n⟦```\n◊\n```⟧\nend"),
    ("example", "Go\n\n⟦Example: ◊⟧\n\nend"),
    ("table", "Rows\n\n⟦| a | b |\n|---|---|\n| ◊ | 1 |⟧\n\nend"),
    ("json", 'Use ⟦{"k": "◊"}⟧ here'),
    ("inline-code", "Run ⟦`◊`⟧ here"),
    ("url", "See ⟦https://example.org/◊⟧, here"),
    ("email", "Mail ⟦◊@example.org⟧ here"),
    ("variable", "Fill ⟦{{◊}}⟧ here"),
    ("variable", "Fill ⟦${◊}⟧ here"),
    ("variable", "Fill ⟦{◊}⟧ here"),
    ("variable", "Fill ⟦%(◊)s⟧ here"),
    ("variable", "Fill ⟦<◊>⟧ here"),
    ("quoted-string", 'Say ⟦"◊"⟧ here'),
    ("quoted-string", "Say ⟦“◊”⟧ here"),
    ("quoted-string", "Say ⟦'◊'⟧ here"),
)

# (type, severity, label, prompt)
CONSTRAINTS = (
    ("prohibition", "critical", 'prohibition ("never")', "⟦Never open ◊⟧."),
    ("prohibition", "critical", 'prohibition ("do not")', "So ⟦do not open ◊⟧."),
    ("requirement", "critical", 'requirement ("must")', "It ⟦must open ◊⟧."),
    ("requirement", "critical", 'requirement ("ensure")', "And ⟦ensure ◊⟧; stop"),
    ("format", "critical", "serialisation format", "Give ◊ ⟦as YAML⟧."),
    ("format", "critical", "output language", "Speak of ◊ ⟦in German⟧."),
    ("format", "critical", "output shape", "For ◊ give ⟦no preamble⟧."),
    ("quantity", "critical", "date", "Due ⟦2024-03-05⟧ for ◊."),
    ("quantity", "critical", "amount", "Pay ⟦$40⟧ for ◊."),
    ("quantity", "critical", "percentage", "Keep ⟦40%⟧ of ◊."),
    ("quantity", "critical", "measurement", "Wait ⟦30 seconds⟧ for ◊."),
    ("quantity", "critical", "count limit", "Take the ⟦top 5⟧ of ◊."),
    ("quantity", "critical", "version", "Use ⟦v2.1⟧ of ◊."),
    ("quantity", "critical", "threshold", "Stop ⟦above 70⟧, ◊."),
    ("quantity", "critical", "count", "Take ⟦12 apples⟧ of ◊."),
    ("literal", "critical", "quoted literal", 'Say ⟦"hello there"⟧ to ◊.'),
    ("literal", "critical", "URL", "See ⟦https://example.org/a⟧ for ◊."),
    ("literal", "critical", "email address", "Mail ⟦ann@example.org⟧ about ◊."),
    ("literal", "critical", "JSON string", 'Use {⟦"key"⟧: 12345} for ◊.'),
    ("variable", "critical", "template variable", "Fill ⟦{{name}}⟧ with ◊."),
    ("entity", "minor", "inline code", "Run ⟦`x1`⟧ for ◊."),
    ("entity", "minor", "identifier", "Set ⟦max_rows⟧ for ◊."),
    ("entity", "minor", "path", "Read ⟦src/main.py⟧ for ◊."),
    ("entity", "minor", "acronym", "Ask ⟦NASA⟧ about ◊."),
    ("entity", "minor", "proper noun", "Ask ⟦Berlin⟧ about ◊."),
    ("example", "minor", "example block", "Go\n\n⟦Example: ◊⟧\n\nend"),
    ("instruction", "minor", "imperative instruction", "⟦Write about ◊⟧."),
)

# (kind, prompt) of what varies from call to call.
MARKERS = (
    ("section", "Do it.\n⟦User:⟧ ◊"),
    ("section", "Do it.\n⟦<context>⟧ ◊"),
    ("date", "Do it, ⟦current date⟧ is ◊"),
    ("date", "Do it, from ⟦2024-03-05⟧ on ◊"),
    ("identifier", "Do it for ⟦session id⟧ ◊"),
    ("identifier", "Do it for ⟦123e4567-e89b-42d3-a456-426614174000⟧ ◊"),
    ("variable", "Do it for ⟦{{topic}}⟧ ◊"),
    ("date", "Do it for ⟦{{today}}⟧ ◊"),
    ("identifier", "Do it for ⟦{{trace}}⟧ ◊"),
)

# (prompt, all constraints as type|label|anchor in order): forms of constraints that the ones above leave out.
INVENTORIES = (
    ("Give ◊ as a YAML list response.", ("instruction|imperative instruction|Give ◊ as a YAML list response", "format|serialisation format|YAML list")),
    ("Respond about ◊ as a markdown table.", ("format|output shape|Respond about ◊ as a markdown", "instruction|imperative instruction|Respond about ◊ as a markdown table", "format|output shape|markdown table")),
    ("So list ◊ in bullet points.", ("format|output shape|bullet points",)),
    ("So put ◊ in 40 words.", ("format|length limit|40 words",)),
    ("For ◊ use at most 3 fluffy clouds.", ("format|output budget|at most 3 fluffy",)),
    # A budget of units of measure is a quantity, not a format.
    ("For ◊ wait at most 3 hours.", ("quantity|count limit|at most 3", "quantity|measurement|3 hours")),
    ("So tell ◊ in the user's language.", ("format|output language|in the user's language",)),
    ("So give ◊ and nothing else.", ("format|output shape|nothing else",)),
    # Patterns of length and budget know small letters only.
    ("At most 5 words for ◊.", ("quantity|count limit|At most 5", "format|length limit|5 words")),
    # Markers inside a filler demand nothing.
    ("It should be noted that ◊ works.", ()),
    ("Do not open ◊, and then stop.", ('prohibition|prohibition ("do not")|Do not open ◊', "instruction|imperative instruction|Do not open ◊, and then stop")),
    ("Never open ◊ - ever.", ('prohibition|prohibition ("never")|Never open ◊',)),
    # A clause is cut at a word where it gets long.
    ("Never open it " + "word " * 50 + "then ◊.", ('prohibition|prohibition ("never")|Never open it' + " word" * 41,)),
    ("Ask Dr.X, e.g. about ◊. Then go.", ("instruction|imperative instruction|Ask Dr.X, e.g. about ◊",)),
    ("1. Never stop ◊. 2. Go.", ('prohibition|prohibition ("never")|Never stop ◊',)),
    ("# Never open ◊!!", ('prohibition|prohibition ("never")|Never open ◊',)),
    ("Due 3/4/2024 for ◊.", ("quantity|date|3/4/2024",)),
    ("So take 7 of the ◊.", ()),
    ("Use of ◊ is fine.", ()),
    ("Mix ◊.", ()),
    ("So set MAX_ROWS and maxRows for ◊.", ("entity|identifier|MAX_ROWS", "entity|identifier|maxRows")),
    ("So ask JSON, NASA and NASA for ◊.", ("entity|acronym|NASA",)),
    ("Berlin asks Berlin about ◊.", ("entity|proper noun|Berlin",)),
)

# (prompt, kinds of the regions in order, rewritten): regions that overlap, rules that overlap, rules inside regions.
OVERLAPS = (
    ('Say "go please to https://a.b/◊" now', "url", 'Say "go to https://a.b/◊" now'),
    ("| a `please b` |\n|---|---|\n| ◊ | 1 |\n\nend", "table", "| a `please b` |\n|---|---|\n| ◊ | 1 |\n\nend"),
    ('Use {"k": "{{◊}} please x"} here', "json", 'Use {"k": "{{◊}} please x"} here'),
    ('Mail "please a@b.org ◊" here', "email", 'Mail "a@b.org ◊" here'),
    ("See ${https://a.b/please } ◊", "url", "See ${https://a.b/please } ◊"),
    ("Example: please ◊ x\n\n`please y` end", "example,inline-code", "Example: please ◊ x\n\n`please y` end"),
    ("```\nExample: please ◊\n```\nplease go", "code-fence", "```\nExample: please ◊\n```\ngo"),
    ("See https://a.b/please ◊", "url", "See https://a.b/please ◊"),
    ("Fill <please ◊> please now", "variable", "Fill <please ◊> now"),
    ("Say “please ◊” please now", "quoted-string", "Say “please ◊” now"),
    ("Could you please open ◊ now?", "", "Open ◊ now?"),
    ("Go in order to   ◊.", "", "Go to   ◊."),
    ("Please kindly open ◊.", "", "Open ◊."),
)


def parts(prompt: str) -> tuple[str, str, str]:
    """Before, in and after the brackets."""
    before, _, rest = prompt.partition("⟦")
    found, _, after = rest.partition("⟧")
    return before, found, after


def dealt(spark: SparkSession, events: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Each event with one of ``rows``, in turn; templates are filled with its type."""
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "number long, " + schema)
    # A few dozen rows of fixed text.
    return events.withColumn("number", F.col("event_id") % len(rows)).join(F.broadcast(numbered), "number")


def filled(template: str) -> Column:
    return F.replace(F.col(template), F.lit("◊"), F.col("event_type"))
