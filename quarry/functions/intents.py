"""What a request asks for: its task, its central intent, and where it is routed, as columns.

Each classifier is an ordered table of conditions; the first that holds decides.
Conditions are patterns over the request with its blanks squeezed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .queries import EXCLUDED_PREFIXES, TAG, squeeze

# Patterns of requests, alike in Java and RE2; case does not count.
STRICT = (
    r"\buse\s+only\s+(?:the\s+)?(?:provided\s+)?(?:documentation|documents|records|context)\b",
    r"\bbased\s+only\s+on\s+(?:the\s+)?(?:provided\s+)?(?:documentation|documents|records|context)\b",
    r"\baccording\s+to\s+(?:the\s+)?(?:provided\s+)?(?:documents|documentation|records)\b",
    r"\b(?:don'?t|do\s+not)\s+use\s+outside\s+information\b",
    r"\b(?:don'?t|do\s+not)\s+invent\b",
    r"\bstrictly\s+from\s+(?:the\s+)?(?:provided\s+)?(?:documents|documentation|records)\b",
    r"\bstrictly\s+based\s+on\b",
)
PICTURES = (
    r"\b(?:generate|create|make|render|draw|produce|synthesize|output|build|paint|sketch|illustrate)\b.*?\b(?:an?\s+)?(?:image|picture|photo|photograph|illustration|diagram|rendering|graphic|visual\s+representation|visual|schematic\s+image)\b",
    r"\b(?:text-to-image|txt2img|stable\s*diffusion|diffusion\s*image|diffusion\s*model)\b",
    r"\bvisual\s+representation\s+of\b",
)
FILES = {
    "png": PICTURES,
    "pdf": (r"\b(?:create|generate|export|prepare|save|output|produce|build|draft|write|download|make)\b.*?\b(?:a|an|the|as|into)?\s*(?:actual\s+)?pdf\b", r"\bpdf\s+(?:file|document|report|artifact|export)\b", r"\bexport\s+(?:as|to)?\s*pdf\b", r"\bas\s+(?:an?\s+)?(?:actual\s+)?pdf\s+artifact\b", r"\bdownloadable\s+(?:pdf|report)\b"),
    "docx": (r"\b(?:create|generate|export|prepare|save|output|produce|build|draft|write|download|make)\b.*?\b(?:a|an|the|as|into)?\s*(?:actual\s+)?(?:word\s+doc(?:ument)?|docx)\b", r"\b(?:docx|word\s+document)\s+(?:file|document|report|artifact|export)\b", r"\bexport\s+(?:as|to)?\s*(?:docx|word)\b", r"\bas\s+(?:an?\s+)?(?:actual\s+)?(?:docx|word)\s+artifact\b"),
    "xlsx": (r"\b(?:create|generate|export|prepare|save|output|produce|build|draft|write|download|make)\b.*?\b(?:a|an|the|as|into)?\s*(?:actual\s+)?(?:excel|spreadsheet|xlsx)\b", r"\b(?:xlsx|excel\s+(?:sheet|spreadsheet))\s+(?:file|sheet|spreadsheet|artifact|export)\b", r"\bexport\s+(?:as|to)?\s*(?:xlsx|excel)\b", r"\bas\s+(?:an?\s+)?(?:actual\s+)?(?:excel|xlsx)\s+artifact\b"),
    "pptx": (r"\b(?:create|generate|export|prepare|save|output|produce|build|draft|write|download|make)\b.*?\b(?:a|an|the|as|into)?\s*(?:actual\s+)?(?:powerpoint|presentation|pptx|slide\s+deck)\b", r"\b(?:pptx|powerpoint)\s+(?:file|presentation|artifact|export)\b", r"\bexport\s+(?:as|to)?\s*(?:pptx|powerpoint)\b", r"\bas\s+(?:an?\s+)?(?:actual\s+)?(?:pptx|powerpoint)\s+artifact\b"),
}
EMAIL = ("draft an email", "draft email", "write an email", "write email", "compose an email", "compose email", "send an email", "send email", "prepare an email")
APPROVAL = ("draft an approval note", "draft approval note", "prepare an approval note", "generate an approval note", "create an approval note", "write an approval note", "draft recommendation note", "prepare recommendation note")
REPORT = ("prepare a report", "generate a report", "write a report", "inspection report", "maintenance report", "technical report", "create a report")
CHECKLIST = ("generate a checklist", "prepare a checklist", "create a checklist", "make a checklist", "checklist for")
PROCEDURE = ("generate a procedure", "step-by-step procedure", "sop for", "procedure for", "operational procedure", "standard operating procedure")
COMPARISON = ("compare", "comparison", "differences between", "versus", " vs ")
EXTRACTION = ("what fields", "list all fields", "extract the following", "required fields", "fields are required", "fields required", "template requires", "in the template", "template fields", "approval note template")
SAFETY = ("safety requirements", "safety precautions", "hot work", "work permit", "ppe", "loto", "oisd")
SPECIFICATION = ("design pressure", "operating pressure", "specs of", "specification", "knockout drum")
TROUBLE = ("troubleshoot", "root cause", "failure mode")
#: (words, operation, purpose) of e-mails, in order.
EMAIL_PURPOSES = (
    (("summariz", "summary", "overview"), "summarize", "summary"),
    (("requesting approval", "request approval", "ask for approval", "seek approval", "obtain approval"), "draft_approval_request", "approval_request"),
    (("requesting confirmation", "request confirmation", "ask to confirm", "confirming"), "draft_email", "confirmation_request"),
    (("notifying", "notify", "inform", "notification"), "draft_notification", "notification"),
    (("take action", "action required", "requesting action", "ask the team to"), "draft_action_request", "action_request"),
    (("recommending", "recommendation"), "draft_recommendation", "recommendation"),
    ((), "draft_email", "general"),
)
#: (words, operation, output, archetype) of requests for text, in order, after e-mails.
TEXTS = (
    (APPROVAL, "draft_approval_request", "approval_note", "approval_note"),
    (REPORT, "generate_report", "report", "report"),
    (CHECKLIST, "generate_checklist", "checklist", "procedure"),
    (PROCEDURE, "generate_procedure", "procedure", "sop_retrieval"),
    (COMPARISON, "compare", "table", "comparison"),
    (EXTRACTION, "extract", "extraction", "extraction"),
    (("summarize", "summary", "brief overview", "short summary"), "summarize", "summary", "summary"),
    (("list", "enumerate"), "list", "list", "general_qa"),
    (("explain", "how does", "why does", "describe"), "explain", "direct_qa", "general_qa"),
    (("calculate", "compute"), "calculate", "direct_qa", "general_qa"),
    (SAFETY, "answer", "direct_qa", "safety_compliance"),
    (SPECIFICATION, "answer", "direct_qa", "specification"),
    (("maintenance action", "maintenance recorded", "inspection action"), "answer", "direct_qa", "maintenance"),
    (TROUBLE, "answer", "direct_qa", "troubleshooting"),
    ((), "answer", "direct_qa", "general_qa"),
)
#: (words, archetype) of requests for a document file, in order.
DOCUMENTS = (
    (EMAIL, "email"),
    (APPROVAL, "approval_note"),
    (COMPARISON, "comparison"),
    (SAFETY, "safety_compliance"),
    ((*PROCEDURE, "sop", "procedure", "step-by-step"), "sop_retrieval"),
    (("summarize", "summary", "overview"), "summary"),
    (SPECIFICATION, "specification"),
    (TROUBLE, "troubleshooting"),
    ((), "report"),
)
RECIPIENTS = (
    r"(?i)\b(?:for|to)\s+(?:the\s+)?((?:[A-Za-z0-9\-]+\s+){0,4}(?:team|manager|personnel|operators?|engineers?|department|staff|crew|group|officers?|in-charge))\b",
    r"(?i)\baddressed\s+to\s+(?:the\s+)?((?:[A-Za-z0-9\-]+\s+){0,4}[A-Za-z0-9\-]+)(?:\.|,|$|\s+(?:using|use\s+only|based\s+on|according\s+to|strictly))",
    r"(?i)\bnotifying\s+(?:the\s+)?((?:[A-Za-z0-9\-]+\s+){0,4}[A-Za-z0-9\-]+)(?:\.|,|$|\s+(?:about|regarding|of|on|that|using|use\s+only|based\s+on))",
    r"(?i)\basking\s+(?:the\s+)?((?:[A-Za-z0-9\-]+\s+){0,4}[A-Za-z0-9\-]+)\s+to\b",
    r"(?i)\bto\s+(?:the\s+)?([A-Z][a-zA-Z0-9\-]+(?:\s+[A-Z][a-zA-Z0-9\-]+){0,3})(?:\.|,|$|\s+(?:using|use\s+only|based\s+on|according\s+to|strictly|regarding|about|on))",
)
NOT_RECIPIENTS = ("the following", "each", "all", "clarity", "details", "review", "reference", "documentation", "records", "context", "safe operation", "compliance", "hot work", "cold work", "inspection", "maintenance", "isolation")
#: What is taken off a request, in order, to leave its topic.
TOPIC_CUTS = (
    r"(?i)^(?:create|generate|prepare|export|draft|write|output|build|produce)\s+(?:an?\s+)?(?:actual\s+|professional\s+|downloadable\s+)?(?:pdf|docx|xlsx|pptx|word|excel|spreadsheet|presentation|powerpoint|slide\s+deck|report|file|document|table|artifact|summary|briefing|checklist|email)?\s*(?:report|file|document|presentation|spreadsheet|summary|table|artifact)?\s*(?:containing|summarizing|comparing|detailing|describing|covering|on|about|of|for)?\s*(?:a\s+concise\s+summary\s+of\s+)?(?:the\s+documented\s+|the\s+available\s+|the\s+)?",
    r"(?i)^(?:draft\s+(?:an?\s+)?email\s+(?:summarizing|requesting\s+approval\s+(?:for|of)|requesting\s+confirmation\s+(?:for|of)|notifying\s+(?:the\s+team\s+about|about)|regarding|on)|summarize|write\s+(?:an?\s+)?email\s+(?:about|on|summarizing)|prepare\s+(?:an?\s+)?report\s+on)\s+",
    r"(?i)^the\s+",
    r"(?i)\s+(?:after\s+creating|after\s+generating|generate\s+and\s+return|and\s+return\s+the\s+real|generate\s+the\s+report\s+as|return\s+the\s+generated\s+file|so\s+the\s+user\s+can\s+download).*",
    r"(?i)\s+(?:using|use\s+only|based\s+on|according\s+to|strictly|include\s+the|include\s+source|include\s+a\s+title|do\s+not\s+use|keep\s+the\s+two).*",
    r"[?.!]+$",
)
NO_TOPIC = "Engineering & Compliance Report"

EXISTING = (
    r"\b(?:this|the|that|attached|uploaded|scanned|sample)\s+(?:[\w\s\-]+\s+)?(?:image|picture|photo|photograph|drawing|p\s*&?\s*id|pid|diagram|scan|radiograph|nameplate|plate|document)\b",
    r"\bscanned\s+(?:document|drawing|image|file|report|copy)\b",
    r"\b(?:visible\s+in|shown\s+in|from|on)\s+(?:this|the|that)\s+(?:[\w\s\-]+\s+)?(?:image|picture|photo|drawing|p\s*&?\s*id|pid|diagram|scan|radiograph)\b",
    r"\bwhat\s+does\s+this\s+(?:p\s*&?\s*id|pid|drawing|image|photo|diagram|scan)\s+show\b",
    r"\bwhat\s+(?:anomalies?|defects?|features?)\s+are\s+shown\s+in\b",
    r"\b(?:read|extract)\s+(?:the\s+)?nameplate\b",
    r"\bfind\s+(?:images?|drawings?|photos?)\s+similar\s+to\b",
    r"\b[\w\-./\\]+\.(?:png|jpg|jpeg|tiff|bmp|pdf)\b",
    r"\b(?:datasets|images|drawings|scans)/[\w\-./\\]+",
)
ANALYTICAL = (
    r"\b(?:analyze|analyse|inspect|examine|read|extract|transcribe|ocr|detect|identify|check|audit|review|find)\b",
    r"\bdescribe\s+(?:the\s+)?(?:defects?|flaws?|anomalies?|corrosion|cracks?|features?)\b",
    r"\bwhat\s+does\s+(?:this|the)\b.*?\bshow\b",
    r"\bwhat\b.*?\bshown\s+in\b",
)
IMAGE_FILE = (r"\b[\w\-./\\]+\.(?:png|jpg|jpeg|tiff|bmp)\b",)
VIEWS = (
    r"\b(?:an?\s+)?(?:aerial\s+view|bird'?s[\s\-]eye\s+view|top[\s\-]down\s+view|satellite\s+view|isometric\s+view|panoramic\s+view|3d\s+render(?:ing)?|3d\s+visualization)\s+of\b",
    r"\b(?:from\s+above|from\s+the\s+air|from\s+an\s+aerial\s+perspective)\b",
)
VISUALS = (
    r"\bshow\s+(?:me|us)\s+what\b.*?\b(?:looks?|might\s+look|would\s+look|could\s+look)\s+like\b",
    r"\bwhat\s+(?:would|might|does|could)\b.*?\blook\s+like\b",
    r"\bhow\s+(?:would|might|does|could)\b.*?\blook\b",
    r"\bshow\s+(?:me|us)\s+how\b.*?\blooks?\b",
    r"\b(?:can\s+you\s+)?picture\s+(?:what|how)\b.*?\blook",
    r"\b(?:can\s+you\s+)?picture\s+(?:an?|the)\s+[\w\s]+(?:inside|in|around|at|with)\b",
    r"\b(?:visualize|visualise)\b.*?\b(?:an?|the|what|how)\b",
    r"\bdepict\b.*?\b(?:an?|the|what|how)\b",
    r"\brender\b.*?\b(?:an?|the|what)\b",
    r"\billustrate\b.*?\b(?:an?|the)\b",
    r"\b(?:draw|sketch|paint)\b.*?\b(?:an?|the|what)\b",
    r"\b(?:generate|create|make|produce|synthesize|render|draw|paint|sketch|illustrate|depict|output|build)\b.*?\b(?:an?\s+)?(?:image|picture|photo|photograph|illustration|diagram|rendering|graphic|visual\s+representation|visualization|visual|artwork|drawing|sketch|scene|concept\s+art|3d\s+render)\b",
    r"\b(?:generate|create|make|produce|synthesize|render|draw|paint|sketch|illustrate|depict|output|build)\b.*?\b(?:an?\s+)?(?:realistic|photorealistic|hyperrealistic|detailed\s+visual|3d|isometric|cinematic)\b.*?\b(?:pump|compressor|tower|column|vessel|tank|exchanger|refinery|pipeline|unit|terminal|platform|stack|valve|flare|facility|station|plant)\b",
    r"\b(?:text[\s\-]to[\s\-]image|txt2img|stable\s*diffusion|diffusion\s*image|diffusion\s*model)\b",
    r"\bvisual\s+representation\s+of\b",
)
OFFICE = (
    r"\b(?:create|generate|export|prepare|save|output|produce|build|draft|write|download|make)\b.*?\b(?:a|an|the|as|into)?\s*(?:actual\s+)?(?:pdf|docx|word\s+doc(?:ument)?|excel|spreadsheet|xlsx|powerpoint|pptx)\b",
    r"\b(?:pdf|docx|xlsx|pptx)\s+(?:file|document|report|artifact|export)\b",
    r"\bexport\s+(?:as|to)?\s*(?:pdf|docx|word|excel|xlsx|pptx|powerpoint)\b",
    r"\bas\s+(?:an?\s+)?(?:actual\s+)?(?:pdf|docx|xlsx|pptx)\s+artifact\b",
)
SUMS = (r"\b(?:calculate|compute|verify\s+calculation|check\s+calculation|stress\s+calculation|pressure\s+calculation|flow\s+rate\s+calculation|relief\s+valve\s+sizing|pipe\s+sizing|thickness\s+calculation|mawp|burst\s+pressure|factor\s+of\s+safety|corrosion\s+allowance)\b",)
CODE = (r"\b(?:write\s+code|generate\s+code|write\s+(?:a\s+)?script|write\s+python|write\s+sql|generate\s+python|create\s+a\s+function|code\s+snippet|automate\s+with\s+script)\b",)
#: What follows from each central intent: action, output, target, capability, whether documents are searched.
CENTRAL = {
    "vision": ("analyze_existing", "existing_visual_analysis", "existing_artifact", "vision", False),
    "picture": ("create_new", "new_visual", "new_synthesis", "image_generation", False),
    "document": ("create_new", "document_file", "new_synthesis", "document_generation", True),
    "calculation": ("calculate", "numerical_result", "document_corpus", "calculation", True),
    "code": ("write_code", "code", "new_synthesis", "coding", False),
    "retrieval": ("retrieve_info", "text_answer", "document_corpus", "rag", True),
    "empty": ("unknown", "text_answer", "document_corpus", "rag", True),
}
DRAWING = ("p&id", "piping and instrumentation", "engineering drawing", "process flow diagram", "isometric drawing", "blue print", "ga drawing", "wiring diagram", "loop diagram", "logic diagram", "drawing analysis", "read drawing", "analyze drawing", "inspect drawing")
DRAWING_WORDS = ("pid", "pfd", "blueprint", "schematic")
#: (task, capability, archetype, strings) of requests that no central intent takes, in order. Strings that hold another of their row are left out.
ROUTES = (
    ("document_generation", "document_generation", "report", ()),
    ("image_generation", "image_generation", "general_qa", ()),
    ("coding", "coding", "general_qa", ("write code", "generate code", "write a script", "write script", "write python", "write sql", "generate sql", "generate python", "create a function", "implement a", "code snippet", "write function", "script to", "automate", "generate report script")),
    ("engineering_drawing_analysis", "vision", "general_qa", (*DRAWING, "pid diagram", "pfd", "blueprint", "schematic")),
    ("vision_ocr", "vision", "general_qa", ("ocr", "scan", "handwritten", "nameplate", "plate label", "read text from image", "extract text from image", "image text", "document image", "photograph")),
    ("calculation", "calculation", "equipment_lookup", ("calculate", "compute", "verify calculation", "check calculation", "engineering calculation", "stress calculation", "pressure calculation", "flow rate calculation", "heat duty", "pipe sizing", "relief valve sizing", "thickness calculation", "corrosion allowance", "design margin", "factor of safety", "burst pressure", "mawp", "maximum allowable", "hydrostatic test", "nozzle load")),
    ("comparison", "rag", "comparison", ("compare", "comparison", "versus", " vs ", "difference between", "better than", "which is better", "trade-off", "tradeoff", "alternative", "option a vs", "option b")),
    ("reasoning", "rag", "troubleshooting", ("troubleshoot", "fault", "failure", "root cause", "rca", "why is", "why did", "abnormal", "alarm", "trip", "high temperature", "high pressure", "low flow", "cavitation", "surge", "vibrating", "leak", "chatter", "erratic", "unstable", "not working", "failed", "broken", "investigate cause", "engineering reasoning", "determine why")),
    ("summarization", "rag", "general_qa", ("summarize", "summary", "brief overview", "overview of", "synopsis", "recap")),
    ("extraction", "rag", "equipment_lookup", ("extract", "list all tags", "find tag", "pull out data", "get all tags", "parse tags", "retrieve tags")),
    ("document_qa", "rag", "safety_compliance", ("safety", "hazard", "oisd", "api 510", "api 570", "api 650", "asme", "pngrb", "permit to work", "ptw", "loto", "lockout", "hot work", "confined space", "emergency", "evacuation", "sds", "explosive", "flammable", "toxic", "h2s", "hydrogen sulphide", "fire & gas", "fire and gas", "ppe", "personal protective", "regulatory", "compliance", "statutory")),
    ("document_qa", "rag", "sop_retrieval", ("sop", "procedure", "step by step", "step-by-step", "how to", "startup", "shutdown", "commissioning", "isolation", "depressurization", "purging", "flushing", "handover", "operational sequence", "operating manual", "operation manual")),
    ("document_qa", "rag", "maintenance", ("maintenance", "inspection", "overhaul", "turnaround", "ta ", "preventive", "predictive", "corrective", "lubrication", "alignment", "vibration", "bearing", "seal replacement", "gasket", "torque", "ndt", "non-destructive", "thickness measurement", "corrosion monitoring")),
    ("document_qa", "rag", "equipment_lookup", ("design pressure", "design temperature", "operating pressure", "operating temperature", "flow rate", "capacity", "rating", "metallurgy", "material of construction", "moc", "equipment tag", "tag number", "p-", "e-", "v-", "t-", "k-", "pump", "compressor", "vessel", "heat exchanger", "column", "reactor", "separator", "drum", "tank", "valve", "instrument", "transmitter", "controller", "datasheet", "data sheet", "specification", "refinery", "cdu", "vdu", "fccu")),
    ("general_qa", "rag", "general_qa", ("what is", "what are", "explain", "describe", "define", "tell me", "who is", "how does", "hello", "hi", "help me understand")),
)
#: Patterns of the first two routes.
ROUTE_PATTERNS = {
    "document_generation": (r"\b(?:create|generate|export|prepare|save|output|produce|build|draft|write|download|make)\b.*\b(?:actual\s+)?(?:pdf|docx|word\s+document|excel|spreadsheet|xlsx|powerpoint|pptx)\b", r"\b(?:pdf|docx|xlsx|pptx)\s+(?:file|document|report|artifact|export)\b", r"\bexport\s+(?:as|to)\s*(?:pdf|docx|word|excel|xlsx|pptx|powerpoint)\b", r"\bas\s+(?:an?\s+)?(?:actual\s+)?(?:pdf|docx|xlsx|pptx)\s+artifact\b"),
    "image_generation": PICTURES,
}
#: (words, tool) of document files, in order.
OFFICE_TOOLS = ((("xlsx", "excel", "spreadsheet"), "xlsx_generator"), (("pptx", "powerpoint", "slide"), "pptx_generator"), (("docx", "word"), "document_generator"), ((), "pdf_generator"))
TOOLS = {"calculation": "calculator", "image_generation": "image_generator", "vision": "vision_inspector", "coding": "code_interpreter"}


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for any of several, in either case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def plain(words: tuple[str, ...]) -> str:
    """One pattern for any of several strings."""
    return "|".join("".join("\\" + c if c in r".\+*?()[]{}|^$&-" else c for c in w) for w in words)


def first(table: list[tuple[Column | None, object]]) -> Column:
    """The value of the first row whose condition holds; None always does."""
    return F.coalesce(*[F.lit(v) if not isinstance(v, Column) and c is None else v if c is None else F.when(c, v) for c, v in table])


def has(t: Column, words: tuple[str, ...]) -> Column | None:
    return t.rlike(plain(words)) if words else None


def once(value: Column, body) -> Column:
    """body(value), with value worked out once a row."""
    return F.transform(F.array(value), body)[0]


def capital(x: Column) -> Column:
    return once(F.regexp_replace(x, "^ß", "Ss"), lambda y: F.concat(F.upper(F.substring(y, 1, 1)), F.lower(F.substring(y, 2, 2**30))))


def title(t: Column) -> Column:
    """Each run of letters with a capital."""
    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"[\p{L}]+|[^\p{L}]+"), 0), capital), "")


def recipient(t: Column) -> Column:
    """Whom an e-mail is for, or null."""

    def one(pattern: str) -> Column:
        found = F.trim(F.regexp_replace(F.regexp_extract(t, pattern, 1), r"[,.]+$", ""))
        ok = lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*NOT_RECIPIENTS) & (F.size(F.split(x, r"\s+")) <= 5)
        return once(found, lambda x: F.when(ok(x), title(x)))

    return F.coalesce(*map(one, RECIPIENTS))


def topic(t: Column) -> Column:
    for cut in TOPIC_CUTS:
        t = F.trim(F.regexp_replace(t, cut, ""))
    short = lambda words: F.array_join(F.transform(words, capital), " ")
    return once(t, lambda x: F.when(x == "", NO_TOPIC).when(F.size(F.split(x, r"\s+")) <= 8, short(F.split(x, r"\s+"))).otherwise(title(F.substring(x, 1, 50))))


def equipment(t: Column) -> Column:
    """Sorted tags that a request names."""
    tags = F.transform(F.regexp_extract_all(t, F.lit(TAG), 0), lambda m: F.upper(F.regexp_replace(m, r"(?i)^([A-Z]{1,4})[-_]?", "$1-")))
    part = lambda x, i: F.element_at(F.split(x, "-"), i)
    return F.array_sort(F.array_distinct(F.filter(tags, lambda x: ~part(x, 1).isin(*EXCLUDED_PREFIXES) & ((F.length(part(x, 1)) > 1) | (F.length(part(x, 2)) >= 3)))))


def task(text: Column) -> Column:
    """Struct of operation, output_format, email_purpose, recipient, topic, entities, strict, archetype, artifact."""
    made_of = lambda t: first([(t.rlike(any_of(p)), name) for name, p in FILES.items()] + [(None, F.lit(None).cast("string"))])
    return once(squeeze(F.coalesce(text, F.lit(""))), lambda t: once(made_of(t), lambda artifact: _task(t, artifact)))


def _task(t: Column, artifact: Column) -> Column:
    low = F.lower(t)
    row = lambda operation, output, purpose, archetype: F.struct(F.lit(operation).alias("operation"), F.lit(output).alias("output"), F.lit(purpose).alias("purpose"), F.lit(archetype).alias("archetype"))
    pick = lambda table, made: F.coalesce(*[F.when(has(low, r[0]), made(r)) if r[0] else made(r) for r in table])
    email = has(low, EMAIL)
    document = pick(DOCUMENTS, lambda r: row("generate_document", "artifact", "none", r[1]))
    mail = pick(EMAIL_PURPOSES, lambda r: row(r[1], "email", r[2], "email"))
    text = pick(TEXTS, lambda r: row(r[1], r[2], "none", r[3]))
    found = F.when(artifact == "png", row("generate_image", "image", "none", "general_qa")).when(artifact.isNotNull(), document).when(email, mail).otherwise(text)
    return once(
        found,
        lambda r: F.struct(
            r["operation"].alias("operation"),
            r["output"].alias("output_format"),
            r["purpose"].alias("email_purpose"),
            F.when(email & (r["output"] != "image"), recipient(t)).alias("recipient"),
            topic(t).alias("topic"),
            equipment(t).alias("entities"),
            t.rlike(any_of(STRICT)).alias("strict"),
            r["archetype"].alias("archetype"),
            artifact.alias("artifact"),
        ),
    )


def _kind(t: Column) -> Column:
    """The name in CENTRAL of a request."""
    hit = lambda p: t.rlike(any_of(p))
    looks = hit(ANALYTICAL)
    return first([(t == "", "empty"), (looks & (hit(EXISTING) | hit(IMAGE_FILE)), "vision"), (hit(VISUALS) | hit(VIEWS) & ~looks, "picture"), (hit(OFFICE), "document"), (hit(SUMS), "calculation"), (hit(CODE), "code"), (None, "retrieval")])


def _tool(kind: Column, low: Column) -> Column:
    office = first([(has(low, w), tool) for w, tool in OFFICE_TOOLS])
    return first([(kind == "document_generation", office), *((kind == k, tool) for k, tool in TOOLS.items()), (None, "rag_pipeline")])


def central(text: Column) -> Column:
    """Struct of action, output, target, capability, tool, use_context."""
    t = F.trim(F.coalesce(text, F.lit("")))

    def told(kind: Column) -> Column:
        row = F.coalesce(*[F.when(kind == k, F.struct(*[F.lit(x).alias(n) for n, x in zip(("action", "output", "target", "capability", "use_context"), v, strict=True)])) for k, v in CENTRAL.items()])
        return once(row, lambda r: F.struct(r["action"].alias("action"), r["output"].alias("output"), r["target"].alias("target"), r["capability"].alias("capability"), _tool(r["capability"], F.lower(t)).alias("tool"), r["use_context"].alias("use_context")))

    return once(_kind(t), told)


def route(text: Column) -> Column:
    """Struct of task, capability, archetype, tool, use_context: the central intent first, then the first route that has one of its strings."""
    row = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("task", "capability", "archetype"), v, strict=True)])

    def ruled(t: Column, kind: Column) -> Column:
        drawing = t.rlike(plain(DRAWING)) | t.rlike(rf"\b(?:{'|'.join(DRAWING_WORDS)})\b")
        taken = [(kind == "picture", ("image_generation", "image_generation", "general_qa")), ((kind == "vision") & drawing, ("engineering_drawing_analysis", "vision", "general_qa")), (kind == "vision", ("vision_ocr", "vision", "general_qa")), (kind == "document", ("document_generation", "document_generation", "report")), (kind == "calculation", ("calculation", "calculation", "equipment_lookup")), (kind == "code", ("coding", "coding", "general_qa"))]
        rules = [(t.rlike(any_of(ROUTE_PATTERNS[name])) if name in ROUTE_PATTERNS else has(t, words), (name, capability, archetype)) for name, capability, archetype, words in ROUTES]
        return F.coalesce(*[F.when(c, row(*v)) for c, v in [*taken, *rules]], row("general_qa", "unknown", "general_qa"))

    def told(t: Column) -> Column:
        searched = lambda r: ~r["task"].isin("general_qa", "image_generation", "vision_ocr", "engineering_drawing_analysis", "coding")
        found = once(_kind(t), lambda kind: ruled(t, kind))
        return once(found, lambda r: F.struct(r["task"].alias("task"), r["capability"].alias("capability"), r["archetype"].alias("archetype"), _tool(r["capability"], t).alias("tool"), searched(r).alias("use_context")))

    return once(F.lower(squeeze(F.coalesce(text, F.lit("")))), told)
