"""Patterns, tokens, limits, word sets and messages.

Everything in this module is a constant that results depend on literally, so it
is stated once, in plain text.
"""

# PII types in detection order, with their patterns.
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)"),
    ("credit_card", r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"),
    ("aadhaar", r"(?<!\d)\d{4}[\s-]\d{4}[\s-]\d{4}(?!\d)"),
    ("pan", r"(?i)(?<![A-Z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Z0-9])"),
)

# Type to replacement token.
TOKENS = {
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "credit_card": "[CREDIT_CARD]",
    "aadhaar": "[AADHAAR]",
    "pan": "[PAN]",
    "credential": "[REDACTED]",
}

# Element fields that are inspected and rewritten, in order.
INSPECTED_FIELDS = ("text", "value", "placeholder", "aria_label", "name")

# Own definition (no published one exists): what marks a credential element.
CREDENTIAL_WORDS = (
    "password", "passwd", "passcode", "pin code", "otp",
    "secret", "token", "api key", "credential", "cvv",
)

# Limits per task.
MAX_ACTIONS = 20
MAX_REPLANS = 5
MAX_SECONDS = 120
MAX_CYCLES = 5
REGION_PADDING = 4

# Action sets and the domain allow-list.
POLICY_ALLOWED = ("click", "type", "select")
POLICY_CONFIRM = (
    "submit", "delete", "purchase", "send", "upload", "download", "navigate",
)
PLAN_ACTIONS = ("click", "type", "navigate")
PLAN_STATUSES = ("ready", "completed", "blocked")
VALIDATED_ACTIONS = ("click", "type")
ALLOWED_HOSTS = ("localhost", "127.0.0.1")

# Alias groups of form fields.
FIELD_ALIASES = {
    "name": ("name", "full name", "fullname", "your name"),
    "country": ("country", "nation"),
    "email": ("email", "email address", "e-mail"),
    "phone": ("phone", "phone number", "mobile", "mobile number"),
}

# Phrases that stand for a field or a control.
NAME_FIELD_PHRASES = (
    "name field", "name input", "name textbox", "name text field",
    "enter name", "enter your name",
)
SEARCH_FIELD_PHRASES = ("search field", "search input", "search box", "search textbox")
SEARCH_CLICK_PHRASES = ("search button", "search link", "search")
CONTROL_SUFFIXES = ("field", "input", "textbox", "button", "link")

# Page texts that report success.
SUCCESS_PHRASES = (
    "successfully", "success", "completed successfully",
    "operation completed", "search completed", "task completed",
)

# Lines that look like a transaction.
TRANSACTION_LINE = (
    "₹|INR|Amazon|Salary|Food|Uber|Electricity|Grocery|Recharge|Movie|Restaurant"
)

# What a task says it needs from its user.
MISSING_INFO = (
    (r"\bmy\s+name\b", "your name"),
    (r"\bmy\s+email\b", "your email"),
    (r"\bmy\s+phone\b", "your phone number"),
    (r"\bmy\s+address\b", "your address"),
    (r"\bmy\s+password\b", "your password"),
    (r"\bmy\s+credit\s+card\b", "your credit card information"),
)

# Task patterns.
TASK_SEQUENCE = r"^\s*type\s+(.+?)\s+into\s+(.+?)\s+and(?:\s+then)?\s+click\s+(.+?)\s*$"
TASK_CLICK = r"^\s*(?:click|press|select)\s+(?:the\s+)?(.+?)\s*$"
TASK_TYPE_QUOTED = r"""^\s*type\s+["'](.+?)["']\s+into\s+(?:the\s+)?(.+?)\s*$"""
TASK_TYPE_PLAIN = r"^\s*type\s+(.+?)\s+into\s+(?:the\s+)?(.+?)\s*$"
REQUIRE_TYPE = r"\btype\s+(.+?)\s+into\s+(.+?)(?:\s+and\s+then\s+click\s+.+)?$"
REQUIRE_ENTER = r"\benter\s+(.+?)\s+into\s+(.+?)(?:\s+and\s+then\s+click\s+.+)?$"
REQUIRE_FILL = r"\bfill\s+(.+?)\s+with\s+(.+?)(?:\s+and\s+then\s+click\s+.+)?$"
REQUIRE_TAIL = r"\s+and\s+then\s+click\s+.+$"
CLICK_TARGET = r"\bclick\s+(?:the\s+)?(.+?)\s*$"
CLICK_NOUN = r"^(?:button|link|field|input)\s+(?:with\s+text\s+)?"
FINAL_CLICK = r"(?:^|\s)(?:and\s+|then\s+)?click\s+(?:the\s+)?(.+?)\s*$"

# Selector forms a target may take, with the element types each
# accepts and the attribute it compares.
SELECTOR_FORMS = (
    ("input[name]", "input", "name", ("input", "textarea"), "name"),
    ("textarea[name]", "textarea", "name", ("textarea",), "name"),
    ("input[id]", "input", "id", ("input",), "id"),
    ("textarea[id]", "textarea", "id", ("textarea",), "id"),
    ("input[placeholder]", "input", "placeholder", ("input",), "placeholder"),
    ("input[aria-label]", "input", "aria-label", ("input",), "aria_label"),
)

# Messages of action validation.
MSG_NOT_OBJECT = "Action is not an object."
MSG_UNSUPPORTED = "Unsupported action: "
MSG_TARGET_MISSING = "Action target is missing."
MSG_TARGET_NOT_FOUND = "Target not found: "
MSG_NOT_FOUND_AFTER = "Target not found after normalization: "
MSG_VALUE_MISSING = "Type value is missing."
MSG_VALUE_PLACEHOLDER = "Type value was not provided by the user."
MSG_NOT_TEXT_INPUT = "Target is not a text input: "
MSG_NOT_CLICKABLE = "Target is not clickable: "
MSG_VALID = "Valid action."
VALUE_PLACEHOLDER = "USER_PROVIDED_VALUE"
MSG_PLAN_NOT_LIST = "Action plan is not a list."
MSG_PLAN_EMPTY = "Action plan is empty."

# Messages of the capability policy.
MSG_ALLOWED = "Allowed."
MSG_CONFIRM = "User confirmation required for: "
MSG_BLOCKED_ACTION = "Blocked action: "

# Messages of the popup policy.
POPUP_BLOCKED = "Security policy blocked action: "
POPUP_NOT_ALLOWED = "Security policy does not allow action: "
POPUP_NEEDS_VALUE = "Type action requires a string value."
POPUP_ALLOWED = "Action allowed."

# Messages of execution checks.
EXEC_UNSUPPORTED = "Unsupported action: "
EXEC_UNRESOLVED = "Could not uniquely resolve target: "
EXEC_DISABLED = "Target is disabled: "
EXEC_SELECT_VALUE = "Select action requires a string value."
EXEC_SELECT_ELEMENT = "Select action requires a select element."
EXEC_SELECT_OPTION = "Could not find select option: "
EXEC_TYPE_VALUE = "Type action requires a string value."
EXEC_CREDENTIAL = "Typing into credential fields is blocked."
EXEC_NOT_EDITABLE = "Typing is only allowed into input or textarea fields."

# Reasons of model-plan validation.
PLAN_INVALID = "The local model returned an invalid response."
PLAN_COORDINATES = "The local model returned an unsafe coordinate-based action."
PLAN_BAD_STATUS = "The local model returned an unsupported status."
PLAN_BAD_ACTIONS = "The local model returned invalid actions."
PLAN_BAD_ACTION = "The local model returned an invalid action."
PLAN_BAD_KIND = "The local model returned an unsupported browser action."
PLAN_NO_TARGET = "The local model returned an action without a target."
PLAN_ACTION_COORDINATES = "Coordinate-based browser actions are forbidden."
PLAN_TYPE_VALUE = "The type action does not contain a valid value."
PLAN_TYPES_TOKEN = "The model attempted to type sanitized private information."
PLAN_STRAY_VALUE = "Click actions cannot contain a value."
PLAN_COMPLETED_ACTIONS = "A completed response cannot contain browser actions."
PLAN_BLOCKED = "The local agent blocked the task."
PLAN_MISSING_INFO = "The task requires information that only the user can provide."
TASK_REQUIRED = "Task is required."
COORDINATE_KEYS = ("coordinate", "coordinates", "x", "y")

# Reasons of the next-step decision.
STEP_CLICK = "The requested visible target is available."
STEP_NO_FIELD = "The required input field could not be identified safely."
STEP_CLICK_NEXT = (
    "The required input is already populated and the requested click is the "
    "next required action."
)
STEP_DONE = "The requested input value is already present in the current browser state."
STEP_TYPE = "The requested value is not yet present in the required input."

# Messages shown for a result.
SHOWN_DONE = "Task completed successfully."
SHOWN_LOGIN = (
    "Problem: This task needs protected login information, so it was blocked "
    "for your safety."
)
SHOWN_MISSING = "Problem: Some information needed for this task was not provided."
SHOWN_BLOCKED = "Problem: This action was blocked for your safety."
SHOWN_NO_ACTIONS = "Problem: The agent could not find a safe action to perform."
SHOWN_NOT_READY = "Problem: The AI could not create a safe action plan."
SHOWN_EXEC_FAILED = (
    "Problem: The browser could not safely complete the requested action."
)
SHOWN_MAX_CYCLES = (
    "Problem: The agent could not complete the task within the allowed steps."
)
SHOWN_USER_INFO = "information that only the user can provide"
