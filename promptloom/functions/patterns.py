"""Patterns of prompts, as fixed values.

Written in the ECMAScript dialect, whose ``\\b`` is ASCII and whose ``\\s`` is
Unicode; ``dialect`` turns them into the dialects of Python and Java.
"""

# Fixed values: (label, pattern, flags).
REGIONS = (
    ("inline-code", r'''(`+)(?:(?!\1)[^\n])+\1''', "g"),
    ("url", r'''\b(?:https?://|www\.)[^\s<>"'`)\]]+''', "gi"),
    ("email", r'''\b[\w.+-]+@[\w-]+\.[\w.-]*\w\b''', "g"),
    ("variable", r'''\{\{[^{}\n]*\}\}''', "g"),
    ("variable", r'''\$\{[^{}\n]*\}''', "g"),
    ("variable", r'''\{[A-Za-z0-9_.\-| ]{1,48}\}''', "g"),
    ("variable", r'''%\(\w+\)[sdifr]|%[sdifr]\b''', "g"),
    ("variable", r'''</?[A-Za-z][\w:.-]*(?:\s[^<>\n]*?)?/?>''', "g"),
    ("variable", r'''\[[A-Z][A-Z0-9_ ]{1,32}\]''', "g"),
    ("quoted-string", r'''"[^"\n]{1,300}"''', "g"),
    ("quoted-string", r'''“[^”\n]{0,300}”''', "g"),
    ("quoted-string", r'''(?<=^|[\s([{:;,\-–—])'[^'\n]{1,300}'(?=$|[\s)\]}.,;:!?])''', "g"),
    ("quoted-string", r'''(?<=^|[\s([{:;,\-–—])‘[^’\n]{1,300}’(?=$|[\s)\]}.,;:!?])''', "g"),
)

# Fixed values: (label, pattern, flags).
FORMATS = (
    ("serialisation format", r'''\b(?:in|as|using|into|only|valid|well-formed|strict)\s+(?:json|jsonl|ndjson|yaml|xml|csv|tsv|html|markdown|plain\s+text|plaintext)\b''', "gi"),
    ("serialisation format", r'''\b(?:json|yaml|xml|csv|html|markdown)\s+(?:object|array|list|format|output|response|document|schema|block)\b''', "gi"),
    ("output shape", r'''\b(?:respond|reply|answer|output|return|write|produce|render|format|formatted|structure)\b[^.\n]{0,40}?\b(?:json|yaml|xml|csv|html|markdown|plain text|bullet points?|bulleted list|numbered list|markdown table|table|prose|paragraphs?)\b''', "gi"),
    ("output shape", r'''\b(?:bullet points?|bulleted list|numbered list|markdown table|code block|code fence|one line|single line)\b''', "gi"),
    ("length limit", r'''\b(?:no more than|at most|at least|fewer than|less than|under|over|maximum(?: of)?|max|minimum(?: of)?|min|up to|exactly|around|about|within)?\s*(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)(?:\s*[-–]\s*\d+)?(?:\s+\p{Ll}+){0,2}?\s+(?:words?|sentences?|characters?|chars?|paragraphs?|bullets?|bullet points?|items?|lines?|tokens?|steps?|options?|examples?|questions?|sections?|headings?)\b''', "gu"),
    ("output budget", r'''\b(?:no more than|at most|at least|fewer than|less than|maximum of|minimum of|up to|exactly|between)\s+(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)(?:\s+and\s+\d+)?(?:\s+\p{Ll}+){0,2}?\s+[\p{L}\d][\p{L}\d-]*\b''', "gu"),
    ("output language", r'''\bin\s+(?:english|spanish|french|german|portuguese|italian|japanese|chinese|korean|russian|dutch|hindi|arabic)\b''', "gi"),
    ("output language", r'''\bin the (?:user'?s|same|original|source|target) language\b''', "gi"),
    ("output shape", r'''\bno\s+(?:preamble|prose|explanations?|commentary|markdown|code fences?|extra text|additional text|greetings?|apologies)\b''', "gi"),
    ("output shape", r'''\bnothing else\b|\bwithout (?:any )?(?:explanation|preamble|commentary|extra text)\b''', "gi"),
)

# Fixed values: (label, pattern, flags).
QUANTITIES = (
    ("date", r'''\b\d{4}-\d{2}-\d{2}\b''', "g"),
    ("date", r'''\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b''', "g"),
    ("amount", r'''[$€£]\s?\d[\d,]*(?:\.\d+)?''', "g"),
    ("percentage", r'''\b\d[\d,]*(?:\.\d+)?\s?%''', "g"),
    ("measurement", r'''\b\d[\d,]*(?:\.\d+)?\s?(?:ms|sec|secs|seconds?|mins?|minutes?|hours?|hrs?|days?|weeks?|months?|years?|kb|mb|gb|tb|bytes?|px|degrees?|celsius|fahrenheit|usd|eur|gbp|kg|km|cm)\b''', "gi"),
    ("count limit", r'''\b(?:top|first|last|up to|at most|at least|no more than|maximum of|minimum of|exactly)\s+\d[\d,]*\b''', "gi"),
    ("version", r'''\bv?\d+\.\d+(?:\.\d+)?\b''', "g"),
    ("threshold", r'''\b(?:starting at|start at|beginning at|above|below|over|under|from)\s+\d[\d,]*(?:\.\d+)?\b''', "gi"),
    ("count", r'''\b\d[\d,]*(?:\.\d+)?\s+\p{Ll}[\p{Ll}-]*\b''', "gu"),
)

# Fixed values: (label, pattern, flags).
ENTITIES = (
    ("identifier", r'''\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b''', "g"),
    ("identifier", r'''\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b''', "g"),
    ("identifier", r'''\b[a-z]+(?:[A-Z][a-z0-9]+)+\b''', "g"),
    ("path", r'''\b[\w./-]+\.(?:ts|tsx|js|jsx|py|json|md|ya?ml|sql|csv|txt|html|css|sh|toml|ini)\b''', "g"),
    ("acronym", r'''\b[A-Z]{2,6}s?\b''', "g"),
)

# Fixed values: (label, pattern, flags).
MARKERS = (
    ("prohibition", r'''\b(?:never|do not|don't|does not|doesn't|must not|mustn't|shall not|should not|shouldn't|cannot|can't|may not|will not|won't|avoid|refrain from|under no circumstances|at no point)\b''', "gi"),
    ("requirement", r'''\b(?:must|should|shall|always|only|exactly|required to|require[sd]? that|need to|needs to|have to|has to|it is mandatory|mandatory|ensure that|ensure|make sure(?: that| to)?|be sure to|remember to|at all times)\b''', "gi"),
    ("proper noun", r'''\b\p{Lu}\p{Ll}{2,}\b''', "gu"),
    ("leading marks", r'''^[\s\-*+#>|.)\]]+''', ""),
    ("trailing marks", r'''[\s.,;:!?)\]}"'`|-]+$''', ""),
)

# Fixed values: (label, pattern, flags).
LINES = (
    ("fence", r'''^[ \t]{0,3}(```+|~~~+)''', ""),
    ("example label", r'''^[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*)?(examples?|input|output|sample|ejemplos?|entrada|salida)(?:\*\*)?[ \t]*[:：]''', "i"),
    ("example tag", r'''<example\b[^>]*>[\s\S]*?</example>''', "gi"),
    ("table rule", r'''^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$''', ""),
)

# Fixed values: (label, pattern, flags).
DYNAMIC = (
    ("section label", r'''^[ \t]*(?:#{1,6}[ \t]*)?(?:\*\*|__)?(user(?: query| message| input| question)?|human|question|query|context|documents?|retrieved(?: documents?| context| passages| chunks)?|conversation(?: history)?|chat history|history|transcript|input)(?:\*\*|__)?[ \t]*:''', "i"),
    ("section tag", r'''<(user(?:_(?:query|message|input|question))?|human|question|query|context|documents?|retrieved_?\w*|conversation(?:_history)?|chat_history|history|transcript|input)\b[^>]*>''', "gi"),
    ("date hint", r'''\b(?:current date|current time|current datetime|today'?s date|today is|date today|now is|as of (?:today|now)|timestamp)\b''', "gi"),
    ("iso date", r'''\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?\b''', "g"),
    ("id hint", r'''\b(?:request|session|conversation|thread|trace|correlation|user|customer|account|order|ticket|tenant)[ _-]?(?:id|uuid)s?\b''', "gi"),
    ("uuid", r'''\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b''', "gi"),
    ("date name", r'''(?:^|[^a-z])(date|time|now|today|timestamp|clock|day)(?:[^a-z]|$)''', "i"),
    ("id name", r'''(?:^|[^a-z])(id|uuid|session|request|thread|trace)(?:[^a-z]|$)''', "i"),
)

# Fixed values: (label, pattern, flags).
FILLERS = (
    ("", r'''\bit(?:'s| is) important to note that\b''', "g"),
    ("", r'''\bit should be noted that\b''', "g"),
    ("", r'''\byour (?:task|job|role|goal) is to\b''', "g"),
    ("", r'''\byou are asked to\b''', "g"),
    ("", r'''\b(?:i would like|i'd like|i want|i need) you to\b''', "g"),
    ("", r'''\b(?:could|can|would) you(?: please)?\b''', "g"),
    ("", r'''\bin (?:this|the) task\b''', "g"),
    ("", r'''\bfor this (?:task|request|assignment)\b''', "g"),
    ("", r'''\bthe following is(?: an?)?\b''', "g"),
    ("", r'''\b(?:in my opinion|from my perspective)\b''', "g"),
    ("", r'''\bi (?:think|believe|feel|suppose)\b''', "g"),
    ("", r'''\bas an? (?:ai assistant|ai|assistant|language model|llm)\b''', "g"),
    ("", r'''\b(?:please|kindly)\b''', "g"),
    ("", r'''\b(?:very|really|extremely|quite|rather|fairly|somewhat|totally|absolutely|definitely|certainly|basically|essentially)\b''', "g"),
)

SENTENCE_END = r'''[.!?](?=["')\]]?(?:\s|$))'''
TOKEN = r'''[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*|[%$#]'''
