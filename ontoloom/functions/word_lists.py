"""Word lists, patterns and enumerations of the ontology pipeline, in plain text.

Patterns are written for Java's regular expressions and RE2 alike: no look-around, word boundaries spelt out (WS before, WE behind a word),
because the two disagree on what a word is outside ASCII.
"""

from __future__ import annotations

#: Where a word starts and ends, letters and digits of all scripts being parts of words.
WS, WE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

#: Function words, for term edges, generic spans and tagging.
DETERMINERS = "a an the this that these those some any each every either neither no another such".split()
ADPOSITIONS = "of in on at by for from to with without into onto over under between during before after until since through per via within against about as".split()
CONJUNCTIONS = "and or but nor so yet if unless because while when where whether than though although".split()
PRONOUNS = "i you he she it we they me him her us them my your his its our their who whom whose which what there".split()
AUXILIARIES = "is are was were be been being am do does did done has have had having can could will would shall should may might must not".split()
STOP_WORDS = sorted({*DETERMINERS, *ADPOSITIONS, *CONJUNCTIONS, *PRONOUNS, *AUXILIARIES})

#: Determiners dropped at the front of canonical terms.
LIGHT_PREFIXES = (
    "a an the this that these those some any each every either neither most many much few several various multiple certain particular specific typical general common other default"
).split()
#: Heads of generic terms.
GENERIC_HEADS = (
    "system information data datum value values thing things file files directory path number record records parameter parameters option options setting settings "
    "configuration configurations name names type types"
).split()
#: Strings that anchor a term in the domain, and commands of schedulers.
ANCHORS = "slurm slurmdbd slurmctld slurmd lsf bsub bjobs bqueues".split()
SCHEDULER_COMMANDS = "sacct sreport squeue sinfo srun sbatch salloc scancel scontrol sstat sprio sdiag smap sattach".split()

#: Section headings that are kept, in small letters.
STRUCTURAL_HEADERS = (
    "api functions|api|functions|methods|description|arguments|returns|parameters|examples|example|syntax|usage|notes|note|warnings|warning|input|output|configuration|options|specifications"
).split("|")
#: Lines that are always content. The fourth is meant for capitals and takes any case in the compatible reading.
PRESERVE = [
    r"^(?:int|void|char|const|static|extern|uint[0-9]+_t|bool|float|double|struct|enum|typedef|union|long|short|unsigned|signed)" + WE,
    r"^[a-z_][a-z0-9_]* ?\([^)]*\) ?;?$",
    WS + r"[a-z_][a-z0-9_]* ?\([^)]*\) ?;?$",
    r"^# ?define" + WE,
    r"^# ?include" + WE,
    r"^(?:arguments?|returns?|description|parameters?|example|note|warning|syntax|usage|input|output|overview):$",
    r"^(?:api (?:functions|methods|calls)|function (?:reference|list)|method (?:reference|list))$",
    WS + r"(?:slurm_success|slurm_error|success|error|failure|ok)" + WE,
    r"\([^)]*(?:input|output|in|out|inout)[^)]*\)",
    r"^//",
    r"^/\*",
    r"\*/$",
]
PRESERVE_CAPITALS = r"^[A-Z_][A-Z0-9_]+(?:$|[^\p{L}\p{N}_])"
PRESERVE_WORDS = r"^[A-Za-z_][A-Za-z0-9_]+(?:$|[^\p{L}\p{N}_])"
#: Lines of navigation and print, read without regard to case.
BOILERPLATE = [
    r"^(?:navigation|menu|home|back to top|skip to content)$",
    r"^version [0-9.]+$",
    r"^v[0-9]+\.[0-9]+$",
    r"^release [0-9]+$",
    r"^(?:last modified|last updated|modified:|updated:|date:)(?:$|[^\p{L}\p{N}_].*$|[\p{L}\p{N}_].*$)",
    r"^[0-9]{1,2} (?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{4}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    r"^(?:page|chapter) [0-9]+$",
    r"^[0-9]+$",
    r"^(?:contents|table of contents|references|bibliography)$",
    r"^appendix [a-z]$",
    r"^(?:figure|table) [0-9]+$",
    r"copyright ©",
    r"© ?[0-9]{4}",
    WS + r"all rights reserved" + WE,
    r"^\[?[0-9]+\]?$",
    r"^(?:see also:?|retrieved from|available at:|more information)(?:$|[^\p{L}\p{N}_].*$)",
    r"^[*_=#{3,}-]+$",
    r"^(?:about|overview|using|installing|get(?:ting)? help|get(?:ting)? started|documentation|mailing lists?|support(?: and training)?|training|troubleshooting|faqs?|publications?|downloads?|installation guide|release notes|changelog|related software)$",
    r"^slurm workload manager$",
    r"^schedmd$",
]
PRINT_COPYRIGHT = r"^© ?copyright ibm corp\.? ?[0-9]{4}\.?$"
PRINT_PAGE = r"^(?:ibm spectrum lsf [0-9]+|[0-9]+ ibm spectrum lsf)$"
FOOTER = r"(?:^| )(?:last modified|last updated|modified:|updated:|date:)(?:$|[^\p{L}\p{N}_])"
NAVIGATION_IN_LINE = WS + r"(?:download|documentation|about|help|home|back)" + WE
NAVIGATION_LINE = "home back next previous menu contents index search login logout help".split()
CODE_SYMBOLS = r"[(){}\[\]=;*&|^~]|->|::|<<|>>|!="

#: Fragments that are no sentences, read without regard to case.
FRAGMENTS = [
    r"^[\p{L}\p{N}_]{1,3}$", r"^[a-z]+$", r"^(?:figure|table|example|section|chapter) *[0-9]*\.?$", r"^[0-9]+\.? *$", r"^\([^)]*\)$", r"^[\[\]{}().,;:!?-]+$", r"^(?:none|yes|no)$",
]

#: Heads that are no parents, scheduler names, clause words, and the map of stable parents.
BAD_HEADS = "thing data information value values type types details".split()
SCHEDULERS = "slurm lsf pbs torque sge".split()
CLAUSE_WORDS = "that which used for to with provides responsible".split()
TAIL_PREPOSITIONS = "of in on for to at by from".split()
PARENT_MAP = {
    "queue": "job queue", "scheduler": "job scheduler", "slurm scheduler": "job scheduler", "daemon": "scheduler daemon", "service daemon": "scheduler daemon",
}


def either(words: list[str]) -> str:
    """A group that matches any of the words or patterns."""
    return "(?:" + "|".join(words) + ")"

#: Verbs of the tagger's lexicon, adjectives and adverbs not told by their ending.
VERBS = (
    "run runs start starts stop stops use uses set sets get gets show shows print prints read reads write writes open opens close closes hold holds wait waits end ends need needs keep keeps "
    "update updates replace replaces override overrides extend extends block blocks limit limits drain drains mount mounts record records ignore ignores rewrite rewrites trim trims query queries "
    "signal signals inherit inherits requeue requeues release releases check checks gain gains list lists cover covers delete edit recover recovers exceed exceeds"
).split()
ADJECTIVES = "new old same last next first second big small large long short high low full common further stale nested expired pending current different shared static dynamic local remote".split()
ADVERBS = "very too also not never always often again then here there still just only later finally".split()
NOISE = ["http", "www.", "copyright"]

#: Endings of binaries, units after numbers, models of accelerators that are terms.
ARTIFACT_ENDINGS = "so a o lo la lai dll exe dylib jar class pyc pyo whl".split()
UNITS = "sec secs seconds min mins minutes hour hours day days gb gib mb mib kb kib ms us".split()
ACCELERATORS = "A100 H100 V100 L4 P100 K80 T4".split()
