"""Word lists of the constraint inventory."""

# Units that make a limit a measurement. Fixed values.
MEASURES = frozenset(
    """
    ms sec secs second seconds min mins minute minutes hour hours hr hrs day days week weeks month
    months year years kb mb gb tb byte bytes px degrees celsius fahrenheit usd eur gbp kg km cm ml
    kcal dollars euros rows requests
    """.split()
)

# Words after a number that aren't counted things. Fixed values.
NO_UNITS = frozenset(
    """
    to and or of in on at as is are was were the a an for with by if when that this but so then not
    no be
    """.split()
)

# Acronyms that name a format. Fixed values.
FORMAT_NAMES = frozenset(
    """
    JSON YAML XML CSV TSV HTML JSONL NDJSON
    """.split()
)

# Capitalised words that aren't names. Fixed values.
NO_NAMES = frozenset(
    """
    The This That These Those Your You Yours Our Their They When Where What Which While With Without
    Within From Into Never Always Only Must Should Avoid Ensure Make Note Include Example Examples
    Input Output Format Rules Rule Goal Task Role Step Steps Answer Respond Reply Return Write Use
    Each Every All Any Also Then Else For And But Not Are Can Ask Keep Read Send Show Stop Take Tell
    Give Check Start End Here There Under Over After Before Once Both Some Such
    """.split()
)

# Verbs that open an instruction. Fixed values.
VERBS = frozenset(
    """
    act add analyse analyze answer apply ask assign assume begin break build call check choose cite
    classify collect compare compile compose compute confirm consider convert copy count create
    decide describe detect determine do draft echo edit end escalate evaluate exclude explain
    extract filter find finish fix flag focus follow format generate give group help highlight
    identify ignore include infer inspect keep label limit list log look maintain map mark match
    mention merge name normalise normalize note offer omit output parse perform pick prefer preserve
    prioritise prioritize produce propose provide quote rank read recall recommend redact reduce
    refer reject remove render repeat rephrase reply report respond restate return review rewrite
    run sanitise sanitize say score search select send set show skip sort split start state stay
    stick stop store suggest summarise summarize support tag take tell think transform translate
    treat trim try update use validate verify wait walk work wrap write
    """.split()
)
