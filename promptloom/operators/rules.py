"""Rewrite rules, as fixed values, in order of priority."""

# (id, level, lossy, pattern, flags, replacement)
RULES = (
    ("politeness.please", "balanced", True, r'''\b(?:please|kindly),?[^\S\n]+(?=\S)''', "gi", ''),
    ("frame.polite-request", "balanced", True, r'''\b(?:could you|can you|would you|i would like you to|i'd like you to|i want you to|i need you to)(?:[^\S\n]+please)?,?[^\S\n]+(?=\S)''', "gi", ''),
    ("frame.task-is-to", "balanced", True, r'''\byour (?:task|job|role|goal) is to[^\S\n]+(?=\S)''', "gi", ''),
    ("frame.you-are-asked-to", "balanced", True, r'''\byou are asked to[^\S\n]+(?=\S)''', "gi", ''),
    ("intensifier.degree", "aggressive", True, r'''\b(?:very|really|extremely|quite|rather|fairly|somewhat|totally|absolutely|definitely|certainly|basically|essentially)[^\S\n]+(?=\S)''', "gi", ''),
    ("hedge.opinion", "aggressive", True, r'''\b(?:i think|i believe|i feel|i suppose|in my opinion|from my perspective),?[^\S\n]+(?=\S)''', "gi", ''),
    ("frame.as-an-ai", "aggressive", True, r'''\bas an? (?:ai assistant|ai|assistant|language model|llm),?[^\S\n]+(?=\S)''', "gi", ''),
    ("frame.important-to-note", "aggressive", True, r'''\bit (?:is|'s) important to note that[^\S\n]+(?=\S)|\bit should be noted that[^\S\n]+(?=\S)''', "gi", ''),
    ("frame.in-this-task", "aggressive", True, r'''^(?:in this task|for this (?:task|request|assignment)),?[^\S\n]*''', "gim", ''),
    ("frame.the-following-is", "aggressive", True, r'''\bthe following is (?:an?[^\S\n]+)?''', "gi", ''),
    ("sub.in-order-to", "balanced", False, r'''\b(?:in order to|so as to)\b''', "gi", 'to'),
    ("sub.for-the-purpose-of", "balanced", False, r'''\bfor the purpose of\b''', "gi", 'for'),
    ("sub.because", "balanced", False, r'''\b(?:due to the fact that|for the reason that|owing to the fact that)\b''', "gi", 'because'),
    ("sub.if", "balanced", False, r'''\bin the event that\b''', "gi", 'if'),
    ("sub.now", "balanced", False, r'''\bat (?:this point in time|the present time)\b''', "gi", 'now'),
    ("sub.about", "balanced", False, r'''\b(?:with regard to|with respect to|in regard to|pertaining to|in relation to)\b''', "gi", 'about'),
    ("sub.many", "balanced", False, r'''\ba (?:large|significant|substantial) number of\b''', "gi", 'many'),
    ("sub.most", "balanced", False, r'''\bthe majority of\b''', "gi", 'most'),
    ("sub.although", "balanced", False, r'''\b(?:despite|in spite of) the fact that\b''', "gi", 'although'),
    ("sub.can", "balanced", False, r'''\b(?:has the ability to|have the ability to|is able to|are able to|am able to)\b''', "gi", 'can'),
    ("sub.use", "balanced", False, r'''\bmake use of\b''', "gi", 'use'),
    ("sub.utilize", "balanced", False, r'''\butiliz(e|es|ed|ing)\b''', "gi", 'use:e|es|ed|ing'),
    ("sub.utilization", "balanced", False, r'''\butilization\b''', "gi", 'use'),
    ("sub.before", "balanced", False, r'''\bprior to\b''', "gi", 'before'),
    ("sub.consider", "balanced", False, r'''\btake into (?:account|consideration)\b''', "gi", 'consider'),
    ("sub.help", "balanced", False, r'''\bprovide assistance\b''', "gi", 'help'),
    ("sub.start", "balanced", False, r'''\bcommence\b''', "gi", 'start'),
    ("sub.then", "balanced", False, r'''\bsubsequently\b''', "gi", 'then'),
    ("ws.trailing-space", "light", False, r'''[ \t]+$''', "gm", ''),
    ("ws.repeated-space", "light", False, r'''(\S)[ \t]{2,}(?=\S)''', "g", '$1 '),
    ("ws.blank-lines", "light", False, r'''\n{3,}''', "g", '\n\n'),
    ("ws.nbsp", "light", False, r'''[\u00a0\u2007\u202f]''', "g", ' '),
    ("ws.space-before-punct", "light", False, r'''[ \t]+([,.;:!?])''', "g", '$1'),
    ("md.bullet-marker", "light", False, r'''^([ \t]*)[*+][ \t]+''', "gm", '$1- '),
    ("md.bullet-space", "light", False, r'''^([ \t]*-)[ \t]{2,}''', "gm", '$1 '),
    ("md.ordered-space", "light", False, r'''^([ \t]*\d+[.)])[ \t]{2,}''', "gm", '$1 '),
    ("punct.apostrophe", "light", False, r'''(\p{L})[’‘](\p{L})''', "gu", "$1'$2"),
)
