"""Vocabularies of the classifiers: labels in rank order and the patterns that stand for them.

All values in this module are fixed: results depend on each of them and on their order.
"""

from __future__ import annotations

# Procurement stages from most to least advanced, and their patterns over lower-cased text, in order.
STAGES: dict[str, tuple[str, ...]] = {
    "Active Contract": (
        r"execut\w*\s+(?:a\s+)?contract", r"change order", r"active work", r"extension", r"contract\s+(?:modification|amendment)", r"notice to proceed",
        r"work\s+(?:in progress|underway|ongoing)", r"under construction", r"active\s+construction", r"currently\s+under", r"authoriz\w+.*?execut\w+.*?contract"),
    "Construction Authorization": (
        r"authorize\s+construction", r"award\s+construction", r"construction\s+(?:contract|award|authorization)", r"NTP", r"notice to proceed", r"construction\s+bid\s+award"),
    "Design Authorization": (
        r"authorize\s+design", r"design\s+(?:services|contract|authorization|consultant)", r"consultant\s+selection", r"professional\s+services", r"A/E\s+selection",
        r"engineering\s+services", r"design.{0,20}\d+%", r"\d+%\s*(?:design|complete|completion)"),
    "Prequalification (ITB/RFQ set up)": (
        r"\bitb\b", r"\brfq\b", r"\brfp\b", r"invitation\s+to\s+bid", r"request\s+for\s+(?:qualifications|proposals)", r"solicitation", r"vendor\s+pool", r"prequalif",
        r"bid\s+(?:opening|submission|due)", r"advertis(?:e|ing)\s+(?:for|the)", r"issuance\s+of\s+(?:itb|rfq|rfp)"),
    "Funding Allocated": (
        r"appropriat(?:ion|ed)", r"allocated", r"grant\s+award", r"budget\s+amendment", r"funding\s+(?:approved|authorized|allocated)",
        r"bond\s+(?:issue|proceeds|authorization)", r"resolution\s+.*approv"),
    "Committee Referral": (
        r"refer(?:red)?\s+to\s+.*?committee", r"committee\s+recommendation", r"commission\s+referral", r"land\s+use.*committee", r"finance\s+committee", r"public\s+works\s+committee"),
    "Concept/Discussion": (
        r"discuss(?:ion)?", r"presentation", r"workshop", r"update", r"briefing", r"information\s+item", r"study", r"feasibility", r"assessment", r"evaluation",
        r"planning\s+(?:phase|study|effort)"),
}
CONCEPT = "Concept/Discussion"
NO_STAGE = 99
# Words of an evidence snippet that put it in the future.
FUTURE = r"(?:anticipat|expect|plan(?:ned)?|prepar|upcoming|propos|future|forecast|pending|request(?:ing)?(?:\s+direction))"

# Signal types in table order.
SIGNAL_TYPES: dict[str, tuple[str, ...]] = {
    "Commission Agenda": (r"commission\s+agenda", r"agenda\s+item", r"resolution", r"city\s+commission", r"regular\s+meeting", r"consent\s+agenda", r"public\s+hearing"),
    "Capital Budget": (r"capital\s+(?:budget|improvement|program|plan)", r"\bcip\b", r"capital\s+project", r"five.year\s+(?:capital|cip)"),
    "Procurement (ITB/RFQ)": (r"\bitb\b", r"\brfq\b", r"\brfp\b", r"solicitation", r"procurement", r"invitation\s+to\s+bid", r"bid\s+opportunit"),
    "Policy Direction": (r"ordinance", r"policy\s+memo", r"direction\s+to\s+staff", r"legislative", r"code\s+amendment"),
    "Funding Allocation": (r"grant\s+(?:award|funding)", r"appropriation", r"funding\s+(?:amendment|allocation|source)", r"bond\s+(?:proceeds|authorization|issue)"),
}
# What tells the types of a meeting apart.
MEETING_POLICY = r"ordinance|policy\s+memo|code\s+amendment"
MEETING_FUNDING = r"appropriation|funding\s+allocat|grant\s+award"

# Lifecycle and default timeline of each stage.
LIFECYCLE = {
    "Concept/Discussion": "Concept / Policy Direction", "Committee Referral": "Concept / Policy Direction", "Funding Allocated": "Funding Confirmed",
    "Prequalification (ITB/RFQ set up)": "Procurement Imminent", "Design Authorization": "Design Advancement", "Construction Authorization": "Procurement Imminent",
    "Active Contract": "Active Contract",
}
LIFECYCLE_OF_TYPE = {"Capital Budget": "Budget Inclusion", "Funding Allocation": "Funding Confirmed"}
TIMELINE = {
    "Concept/Discussion": "12+ months", "Committee Referral": "6-12 months", "Funding Allocated": "6-12 months", "Prequalification (ITB/RFQ set up)": "3-6 months",
    "Design Authorization": "3-6 months", "Construction Authorization": "0-3 months", "Active Contract": "0-3 months",
}
# Timeline phrases over lower-cased text, in order, and their formats (group numbers, 0 the whole match).
TIMELINE_PHRASES: tuple[tuple[str, str, tuple[int, ...]], ...] = (
    (r"next\s+(\d+)\s+days", "~%s days", (1,)),
    (r"(?:due|deadline|closes?)\s+(?:by|on|in)\s+(\d+)\s+days", "~%s days", (1,)),
    (r"(?:FY|fiscal\s+year)\s*(\d{4})\s*Q(\d)", "FY%s Q%s", (1, 2)),
    (r"(?:begin|start|commence)s?\s+(?:in\s+)?(?:summer|fall|winter|spring)\s+(\d{4})", "%s", (0,)),
    (r"responses?\s+due\s+(\w+\s+\d{1,2},?\s+\d{4})", "Due %s", (1,)),
    (r"(?:complete|completion)\s+(?:by|date)\s*:?\s*(\w+\s+\d{4})", "Complete %s", (1,)),
)

# Amounts, the words of a context that make one preferred, multipliers in test order.
AMOUNT = r"\$\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?(?:\s*(?:million|M|billion|B))?"
AMOUNT_WORDS = ("project", "total", "contract", "award", "appropriat", "budget")
AMOUNT_UNITS = (("billion", 1e9), ("b", 1e9), ("million", 1e6), ("m", 1e6))

# Friction of one text.
FRICTION_HIGH = (
    r"\blitigation\b", r"\blawsuit\b", r"\bappeal\b", r"\bdeferr?al\b", r"\bdeferred\b", r"\bfunding\s+gap\b", r"\bpermit\s+(?:issue|delay|denied)", r"\bstalled\b", r"\brebid\b",
    r"\bcancell?(?:ed|ation)\b", r"\bprotest\b", r"\blegal\s+challenge\b", r"\binjunction\b", r"\bmoratorium\b")
FRICTION_MODERATE = (
    r"\bdepend(?:s|ency|ent)\b", r"\bcoordination\b", r"\binteragency\b", r"\bpending\s+(?:review|approval)", r"\bcontingent\b", r"\bunclear\s+(?:timeline|funding)",
    r"\bmultiple\s+(?:phases|departments)", r"\benvironmental\s+review\b", r"\bpermitting\b")
# Friction and stalling over the evidence of a whole project.
PROJECT_FRICTION_HIGH = (
    r"\b(?:litigation|lawsuit|appeal|deferral|deferred|funding\s+gap|permit\s+(?:issue|delay|denied)|stalled|rebid|cancell?(?:ed|ation)|protest|legal\s+challenge|injunction|moratorium)\b")
PROJECT_FRICTION_MODERATE = (
    r"\b(?:depend(?:s|ency|ent)|coordination|interagency|pending\s+(?:review|approval)|contingent|unclear\s+(?:timeline|funding)|multiple\s+(?:phases|departments)|"
    r"environmental\s+review|permitting|unfunded|shortfall|community\s+(?:opposition|concern)|hearing\s+required)\b")
STALLED = (
    r"\b(?:postponed?|deferr?(?:ed|al)?|delay(?:ed)?|stalled|no\s+action|tabled|held\s+over|withdrawn?|cancell?(?:ed|ation)|suspended?|rebid|re-advertis)\b")

# Marks of a strong signal.
STRENGTH_CODE = r"\b(?:ITB|RFQ|RFP|Resolution|Ordinance)\s*[-#]?\s*\d"
STRENGTH_PROJECT = r"(?:project\s*(?:no|#|id))\s*:?\s*\w"
STRENGTH_VERB = r"(?:approv|authoriz|award|adopt|execute|ratif)"
STRENGTHS = {"High": 0, "Medium": 1, "Low": 2}

# Trigger phrases in order; the phrase ends at a full stop followed by white space, or at the end.
TRIGGERS = (
    r"((?:ITB|RFQ|RFP)\s*[-#]?\s*[\w-]+\s+.*?)(?:\.\s|$)",
    r"(issuance\s+of\s+(?:ITB|RFQ|RFP)\s*[-#]?\s*[\w-]+.*?)(?:\.\s|$)",
    r"((?:bid|solicitation)\s+(?:opening|submission|due|advertised).*?)(?:\.\s|$)",
    r"((?:resolution|ordinance).*?authoriz\w+.*?(?:contract|design|construction|execute).*?)(?:\.\s|$)",
    r"(authoriz\w+.*?(?:execute|award|negotiate).*?contract.*?)(?:\.\s|$)",
    r"(commission\s+approv(?:al|ed)\s+(?:of\s+)?.*?)(?:\.\s|$)",
    r"((?:FY|fiscal\s+year)\s*\d{4}.*?(?:capital\s+budget|CIP|appropriat).*?)(?:\.\s|$)",
    r"((?:emergency\s+)?appropriation\s+of\s+\$[\d,.]+\s*(?:million|M|billion|B)?.*?)(?:\.\s|$)",
    r"((?:grant|funding)\s+(?:awarded?|allocated?|approved?)\s+(?:for\s+)?.*?)(?:\.\s|$)",
    r"(design.{0,20}\d+%\s*complet\w+.*?)(?:\.\s|$)",
    r"(construction\s+(?:to\s+)?(?:begin|start|commence)\w*\s+.*?)(?:\.\s|$)",
    r"(under\s+construction.*?(?:completion|complete).*?)(?:\.\s|$)",
    r"(refer(?:red)?\s+to\s+.*?committee.*?)(?:\.\s|$)",
    r"(change\s+order\s+\w+[-\d]+\s+approved.*?)(?:\.\s|$)",
    r"((?:executed?|awarded?)\s+(?:a\s+)?contract\s+with\s+.*?)(?:\.\s|$)",
)

# Agencies, places and meeting dates, each in order.
AGENCIES = (
    r"(?:(?:City|Village|Town|County|Municipality|Borough)\s+of\s+[\w\s]+?)(?=\s+(?:Commission|Department|Division|Office|Council|Board))",
    r"(?:[\w\s]+?\s+(?:County|District))(?=\s+(?:Water|Sewer|Stormwater|Public\s+Works))",
    r"(?:Department\s+of\s+[\w\s]+)",
)
PLACES = (r"(?:city[-\s]?wide)", r"(?:village[-\s]?wide)", r"(?:district\s+\d+)", r"(?:zone\s+\d+)", r"(?:ward\s+\d+)")
MEETING_DATES = (
    r"(?:meeting|session|hearing)\s+(?:of|on|date)\s*:?\s*(\w+\s+\d{1,2},?\s+\d{4})",
    r"(\w+\s+\d{1,2},?\s+\d{4})\s+(?:meeting|session|regular|special|commission)",
    r"(?:dated?|held)\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"(?:dated?|held)\s*:?\s*(\w+\s+\d{1,2},?\s+\d{4})",
)
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATES = (r"\b(\d{1,2}/\d{1,2}/\d{4})\b", r"\b(\d{4}-\d{2}-\d{2})\b", rf"\b({_MONTH}\s+\d{{1,2}},?\s+\d{{4}})\b", rf"\b(\d{{1,2}}\s+{_MONTH}\s+\d{{4}})\b")

# Project identifiers (group 1), and words that title comparison leaves out.
PROJECT_IDS = (
    r"\b(CIP[-\s]?\w{1,4}[-\s]?\d{4}[-\s]?\d{1,4})\b", r"\b(ITB\s*[-#]?\s*\d{4}[-\s]?\d{2,4}[-\s]?\w{0,4})\b", r"\b(RFQ\s*[-#]?\s*\d{4}[-\s]?\d{2,4}[-\s]?\w{0,4})\b",
    r"\b(RFP\s*[-#]?\s*\d{4}[-\s]?\d{2,4}[-\s]?\w{0,4})\b", r"\b(FBO[-\s]?\d{4}[-\s]?\w{1,4}[-\s]?\d{1,4})\b", r"(?:project\s*(?:id|no|#|number)\s*[:.]?\s*)([\w-]+)",
    r"\b(Resolution\s+(?:No\.?\s*)?\d{4}[-\s]?\d+)\b")
STOPWORDS = ("a an the of for and in to on at by with from city miami beach county project services improvement improvements program").split()

# The default keyword packs.
SECTORS: dict[str, tuple[str, ...]] = {
    "stormwater": (
        "stormwater", "storm water", "storm-water", "drainage", "flood control", "flood mitigation", "runoff", "outfall", "pump station", "pumping station", "basin", "culvert",
        "neighborhood improvement", "water quality", "resiliency", "resilience", "green infrastructure", "retention", "detention", "swale", "sea level rise", "tidal valve",
        "backflow preventer"),
    "water": (
        "drinking water", "potable water", "water main", "water treatment", "water supply", "water distribution", "water line", "water pipe", "water meter", "water plant",
        "water utility", "boil water", "water pressure", "water tank", "water storage"),
    "sewer": (
        "sewer", "wastewater", "waste water", "sanitary sewer", "force main", "lift station", "collection system", "sewer line", "sewer main", "sewer lateral", "sewage",
        "inflow and infiltration", "I&I", "WWTP", "sewer rehabilitation"),
}

# Site discovery.
CATEGORY_URLS = (("procurement", ("/procurement/", "/bid", "bidnet")), ("cip", ("/cip/", "/capital")), ("budget", ("/budget/", "/finance/")),
                 ("meetings", ("/clerk/", "/meeting", "/agenda", "/minute", "novusagenda")))
CMS = (("granicus", ("granicus.com",)), ("legistar", ("legistar.com",)), ("novus", ("novusagenda.com",)), ("civicclerk", ("civicclerk.com",)), ("civicplus", ("civicplus.com", "civicengage")))
SEEDS: dict[str, tuple[str, ...]] = {
    "meetings": ("agenda", "meeting", "minute", "/clerk", "/council", "/commission"),
    "procurement": ("procurement", "/bid", "/rfp", "/rfq", "/itb", "solicitation", "vendor", "purchasing"),
    "cip": ("/cip", "capital", "improvement", "public_works", "public-works", "infrastructure", "/projects", "/program", "resilien", "stormwater", "utilit"),
    "budget": ("/budget", "/finance", "/cafr", "fiscal"),
}
EXTENSIONS = {"application/pdf": ".pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/msword": ".doc"}

# Columns of the sinks, their headers and widths.
DISPLAY = (
    ("signal_title", "Signal Title", 40), ("agency", "Agency", 25), ("geography", "Geography", 20), ("sector", "Sector", 14), ("estimated_value", "Estimated Value", 18),
    ("expected_timeline", "Expected Timeline", 18), ("meeting_date", "Meeting Date", 16), ("signal_type", "Signal Type", 22), ("procurement_stage", "Procurement Stage", 28),
    ("lifecycle_stage", "Lifecycle Stage", 24), ("signal_strength", "Signal Strength", 16), ("strategic_fit", "Strategic Fit", 16), ("friction_level", "Friction Level", 14),
    ("momentum", "Momentum", 14), ("trigger_event", "Trigger Event", 40), ("strategic_notes", "Strategic Notes", 55), ("source_link", "Source Link", 50))
AUDIT = (
    ("evidence_snippet", "Evidence Snippet", 50), ("evidence_page", "Evidence Page", 12), ("confidence_score", "Confidence", 10), ("extraction_method", "Method", 10),
    ("source_file_url", "File URL", 40), ("source_page_url", "Page URL", 40))
FILLS: dict[str, dict[str, str]] = {
    "signal_strength": {"High": "C6EFCE", "Medium": "FFEB9C", "Low": "FFC7CE"},
    "strategic_fit": {"Strong Fit": "C6EFCE", "Moderate Fit": "FFEB9C", "Monitor": "D9E2F3", "No Fit": "FFC7CE"},
    "momentum": {"Accelerating": "C6EFCE", "Stable": "D9E2F3", "Stalled": "FFC7CE", "Unclear": "F2F2F2"},
    "friction_level": {"Low": "C6EFCE", "Moderate": "FFEB9C", "High": "FFC7CE"},
}
HEADER_FILLS = ("1F4E79", "4472C4")
