"""Fixed values shared by the operators.

Every constant below is a fixed value: word lists, lookup tables, weights and limits that decide
results, so they are stated plainly and kept in one place.  All of them are small, driver-side and
bounded, and reach the plan as literals.
"""

# ---------------------------------------------------------------------------------------------
# Node kinds
# ---------------------------------------------------------------------------------------------
INTERACTIVE_KINDS = [
    "link", "button", "input", "textarea", "select", "combobox", "checkbox", "radio", "switch",
    "slider", "tab", "menuitem", "canvas",
]
READABLE_KINDS = ["heading", "paragraph", "text", "list", "listitem", "image", "media", "table"]
STRUCTURAL_KINDS = ["form", "dialog", "navigation", "section"]
LIVE_KINDS = ["alert", "status", "log", "tooltip", "progressbar", "timer"]
INPUT_KINDS = ["input", "textarea", "select", "combobox", "checkbox", "radio", "switch", "slider"]
BUTTON_KINDS = ["button"]

# ---------------------------------------------------------------------------------------------
# Accessibility roles
# ---------------------------------------------------------------------------------------------
INTERACTIVE_ROLES = [
    "button", "link", "textbox", "searchbox", "combobox", "listbox", "menuitem",
    "menuitemcheckbox", "menuitemradio", "option", "radio", "checkbox", "switch", "tab", "slider",
    "spinbutton", "scrollbar",
]
READABLE_ROLES = [
    "heading", "paragraph", "text", "statictext", "list", "listitem", "image", "figure", "table",
    "row", "cell", "columnheader", "rowheader",
]
STRUCTURAL_ROLES = [
    "banner", "navigation", "main", "complementary", "contentinfo", "region", "form", "search",
    "dialog", "alertdialog", "article", "section",
]
LIVE_ROLES = ["alert", "status", "log", "marquee", "timer", "tooltip", "progressbar"]
ESSENTIAL_STRUCTURAL_ROLES = ["form", "dialog", "alertdialog"]
FALLBACK_TAGS = ["BUTTON", "A", "INPUT", "SELECT", "TEXTAREA", "FORM", "DIALOG", "CANVAS"]

# Role an HTML element has when the capture carries no accessibility tree.
TAG_ROLE = {
    "BUTTON": "button", "TEXTAREA": "textbox", "OPTION": "option", "H1": "heading",
    "H2": "heading", "H3": "heading", "H4": "heading", "H5": "heading", "H6": "heading",
    "P": "paragraph", "UL": "list", "OL": "list", "LI": "listitem", "IMG": "image",
    "TABLE": "table", "TR": "row", "TD": "cell", "TH": "columnheader", "FORM": "form",
    "DIALOG": "dialog", "NAV": "navigation", "MAIN": "main", "ASIDE": "complementary",
    "HEADER": "banner", "FOOTER": "contentinfo", "ARTICLE": "article", "SECTION": "region",
    "SEARCH": "search", "FIGURE": "figure", "PROGRESS": "progressbar", "OUTPUT": "status",
    "CANVAS": "canvas", "FIELDSET": "group", "SELECT": "combobox",
}

ROLE_TO_KIND = {
    "button": "button", "link": "link", "textbox": "input", "searchbox": "input",
    "combobox": "combobox", "listbox": "select", "checkbox": "checkbox", "radio": "radio",
    "switch": "switch", "slider": "slider", "spinbutton": "slider", "tab": "tab",
    "menuitem": "menuitem", "menuitemcheckbox": "menuitem", "menuitemradio": "menuitem",
    "option": "menuitem",
    "heading": "heading", "paragraph": "paragraph", "text": "text", "statictext": "text",
    "list": "list", "listitem": "listitem", "tree": "list", "treeitem": "listitem",
    "image": "image", "img": "image", "figure": "image", "canvas": "canvas", "table": "table",
    "grid": "table", "treegrid": "table",
    "form": "form", "dialog": "dialog", "alertdialog": "dialog", "navigation": "navigation",
    "region": "section", "article": "section", "main": "section", "banner": "section",
    "complementary": "section", "contentinfo": "section",
    "alert": "alert", "status": "status", "log": "log", "marquee": "log", "timer": "timer",
    "tooltip": "tooltip", "progressbar": "progressbar",
}
TAG_TO_KIND = {
    "BUTTON": "button", "A": "link", "INPUT": "input", "TEXTAREA": "textarea",
    "SELECT": "select", "H1": "heading", "H2": "heading", "H3": "heading", "H4": "heading",
    "H5": "heading", "H6": "heading", "P": "paragraph", "IMG": "image", "TABLE": "table",
    "UL": "list", "OL": "list", "LI": "listitem", "FORM": "form", "DIALOG": "dialog",
    "NAV": "navigation", "OPTION": "menuitem", "CANVAS": "canvas",
}

# ---------------------------------------------------------------------------------------------
# Regions and groups
# ---------------------------------------------------------------------------------------------
ROLE_TO_REGION = {
    "banner": "header", "navigation": "nav", "main": "main", "complementary": "aside",
    "contentinfo": "footer", "dialog": "dialog", "alertdialog": "dialog", "search": "search",
    "form": "form", "alert": "alert", "status": "alert", "log": "alert", "marquee": "alert",
    "timer": "alert", "tooltip": "alert", "progressbar": "alert",
}
TAG_TO_REGION = {
    "HEADER": "header", "NAV": "nav", "MAIN": "main", "ASIDE": "aside", "FOOTER": "footer",
    "DIALOG": "dialog", "FORM": "form", "SEARCH": "search",
}
GROUPING_TAGS = [
    "FORM", "FIELDSET", "ARTICLE", "SECTION", "NAV", "UL", "OL", "DL", "TABLE", "TBODY", "THEAD",
]
GROUPING_ROLES = [
    "form", "group", "menu", "menubar", "navigation", "list", "listbox", "tree", "treegrid",
    "grid", "table", "tablist", "radiogroup", "toolbar", "directory",
]

# ---------------------------------------------------------------------------------------------
# Labels, locators, interactivity, toasts
# ---------------------------------------------------------------------------------------------
MAX_LABEL = 160
TEST_ID_ATTRS = ["data-testid", "data-test", "data-cy", "data-test-id"]
MAX_LOCATOR_VALUE = 200
GENERIC_CLASSES = [
    "container", "wrapper", "inner", "outer", "content", "row", "col", "column", "flex", "grid",
    "block", "inline", "hidden", "visible",
]
CLICK_EVENTS = ["click", "mousedown", "pointerdown"]
LISTENER_ANCESTORS = 5
IMPLICIT_CANDIDATES = 200
TOAST_DATA_ATTRS = ["data-sonner-toast", "data-hot-toast"]
TOAST_CLASS_PARTS = ["Toastify__toast", "ant-message-notice", "ant-message", "chakra-toast"]
MAX_NODES = 2000
OVERLAY_Z = 100
OVERLAY_RATIO = 0.3

# ---------------------------------------------------------------------------------------------
# Query scoring
# ---------------------------------------------------------------------------------------------
LABEL_WEIGHT = {"exact": 0.4, "contains": 0.3, "fuzzy": 0.25}
KIND_WEIGHT = 0.15
REGION_WEIGHT = 0.12
STATE_WEIGHT = 0.03
GROUP_WEIGHT = 0.08
HEADING_WEIGHT = 0.08
VISIBLE_WEIGHT = 0.02
STATE_FIELDS = [
    "visible", "enabled", "checked", "expanded", "selected", "focused", "required", "invalid",
    "readonly",
]

# ---------------------------------------------------------------------------------------------
# Diffs, layers, ranking, rendering
# ---------------------------------------------------------------------------------------------
DIFF_FIELDS = {
    "visible": "vis", "enabled": "ena", "checked": "chk", "selected": "sel", "expanded": "exp",
    "focused": "foc", "required": "req", "invalid": "inv", "readonly": "rdo",
}
STATUS_ROLES = ["status", "alert", "log", "progressbar"]
MAX_TOASTS = 5
MAX_BANNERS = 3
PORTAL_CLASSES = [
    "modal", "dialog", "overlay", "portal", "ReactModal", "MuiModal", "chakra-modal", "ant-modal",
    "el-dialog", "v-dialog",
]
DRAWER_CLASSES = [
    "drawer", "sidebar", "side-nav", "sidenav", "offcanvas", "slide-in", "MuiDrawer",
    "ant-drawer", "el-drawer", "v-navigation-drawer",
]
POPOVER_CLASSES = [
    "dropdown", "popover", "popup", "tooltip", "menu", "autocomplete", "suggestions",
    "MuiPopover", "MuiMenu", "ant-dropdown", "el-dropdown", "el-popover",
]
POPOVER_ROLES = ["menu", "listbox", "tooltip", "tree"]
TOAST_ROLES = ["alert", "status"]
INCLUSIVE_LAYERS = ["popover", "drawer"]
OVERLAY_LAYERS = ["modal", "popover", "drawer"]
AX_SCOPES = {
    "modal": 'role=dialog[aria-modal="true"] >> ',
    "drawer": "role=complementary >> ",
    "popover": "role=menu >> ",
}
CSS_SCOPES = {
    "modal": '[role="dialog"][aria-modal="true"] ',
    "drawer": '[role="complementary"] ',
    "popover": '[role="menu"] ',
}
ACTIONABLE_KIND_WEIGHT = {
    "button": 0.3, "link": 0.25, "input": 0.3, "textarea": 0.25, "select": 0.25, "checkbox": 0.2,
    "radio": 0.2, "switch": 0.2, "combobox": 0.25, "slider": 0.15, "tab": 0.2, "menuitem": 0.2,
}
TRIM_LIMITS = {
    "header": (3, 2), "nav": (3, 2), "main": (5, 5), "aside": (3, 2), "footer": (2, 2),
    "dialog": (5, 5), "search": (2, 2), "form": (5, 3),
}
TRIM_DEFAULT = (5, 3)
KIND_TO_ELEMENT = {
    "button": "btn", "link": "link", "textbox": "inp", "checkbox": "chk", "radio": "rad",
    "combobox": "sel", "image": "img", "heading": "h", "canvas": "canvas", "alert": "alert",
    "status": "alert", "log": "alert", "tooltip": "alert", "progressbar": "alert",
    "timer": "alert",
}

# ---------------------------------------------------------------------------------------------
# privacy
# ---------------------------------------------------------------------------------------------
SENSITIVE_LABEL_PARTS = [
    "password", "passwd", "pass", "secret", "token", "auth", "key", "api_key", "apikey", "otp",
    "pin", "cvv", "cvc", "ssn", "social", "credit", "card",
]
PARTIAL_MASK_TYPES = ["email", "tel", "phone"]
SAFE_PARAMS = [
    "page", "p", "sort", "order", "q", "query", "search", "tab", "view", "limit", "offset",
    "lang", "locale",
]
SECRET_PARAMS = [
    "token", "key", "api_key", "apikey", "auth", "password", "secret", "access_token",
    "refresh_token", "session", "sessionid", "session_id", "credential", "credentials",
]
MAX_URL = 200
SENSITIVE_PURPOSES = ["password", "password_confirm", "card_number", "card_cvv"]
RUNTIME_SENSITIVE_PARTS = [
    "password", "passwd", "secret", "pin", "cvv", "cvc", "card number", "credit card",
    "debit card", "security code",
]

# ---------------------------------------------------------------------------------------------
# forms
# ---------------------------------------------------------------------------------------------
SUBMIT_KEYWORDS = [
    "submit", "send", "continue", "next", "save", "apply", "confirm", "add to", "sign in",
    "log in", "sign up", "register", "search", "buy", "checkout", "purchase", "subscribe",
]
SIGNAL_WEIGHTS = {
    "form_tag": 0.5, "role_form": 0.45, "role_search": 0.4, "fieldset": 0.3,
    "input_cluster": 0.25, "label_input_pairs": 0.2, "submit_button": 0.3, "form_keywords": 0.15,
    "naming_pattern": 0.1,
}
INTENT_KEYWORDS = {
    "login": [("log in", 3), ("login", 3), ("sign in", 3), ("signin", 3), ("email", 0.5),
              ("password", 0.5), ("username", 0.5)],
    "signup": [("sign up", 3), ("signup", 3), ("register", 3), ("create account", 3),
               ("join", 2)],
    "search": [("search", 3), ("find", 2), ("lookup", 2), ("query", 2)],
    "checkout": [("checkout", 3), ("payment", 2), ("order", 2), ("purchase", 2), ("buy now", 3)],
    "filter": [("filter", 3), ("sort", 2), ("refine", 2), ("narrow", 2)],
    "settings": [("settings", 3), ("preferences", 2), ("configuration", 2), ("options", 1)],
    "contact": [("contact", 3), ("message", 1), ("feedback", 2), ("inquiry", 2)],
    "subscribe": [("subscribe", 3), ("newsletter", 3), ("email updates", 2)],
    "shipping": [("shipping", 3), ("delivery", 2), ("address", 1)],
    "payment": [("payment", 3), ("credit card", 3), ("billing", 2), ("card number", 3)],
    "profile": [("profile", 3), ("account", 1), ("personal info", 2)],
}
INPUT_TYPE_PURPOSE = {
    "email": "email", "tel": "phone", "password": "password", "url": "url", "search": "search",
    "date": "date", "datetime-local": "date", "time": "date", "month": "date", "week": "date",
    "number": "quantity", "file": "file", "color": "color",
}
AUTOCOMPLETE_PURPOSE = {
    "email": "email", "tel": "phone", "tel-national": "phone", "tel-local": "phone",
    "password": "password", "new-password": "password", "current-password": "password",
    "username": "username", "name": "full_name", "given-name": "first_name",
    "family-name": "last_name", "additional-name": "name", "nickname": "username",
    "street-address": "street", "address-line1": "street", "address-line2": "address",
    "address-level1": "state", "address-level2": "city", "postal-code": "zip",
    "country": "country", "country-name": "country", "cc-number": "card_number",
    "cc-exp": "card_expiry", "cc-exp-month": "card_expiry", "cc-exp-year": "card_expiry",
    "cc-csc": "card_cvv", "bday": "date_of_birth", "bday-day": "date_of_birth",
    "bday-month": "date_of_birth", "bday-year": "date_of_birth", "url": "url", "photo": "file",
}
LABEL_PURPOSE = {
    "email": ["email", "e-mail", "mail address"],
    "phone": ["phone", "telephone", "mobile", "cell", "contact number"],
    "password": ["password", "passcode", "pin"],
    "password_confirm": ["confirm password", "repeat password", "retype password",
                         "re-enter password"],
    "name": ["name", "full name"],
    "first_name": ["first name", "given name", "forename"],
    "last_name": ["last name", "surname", "family name"],
    "full_name": ["full name", "your name", "customer name"],
    "username": ["username", "user name", "user id", "login", "account name"],
    "address": ["address", "location"],
    "street": ["street", "address line", "street address"],
    "city": ["city", "town", "locality"],
    "state": ["state", "province", "region"],
    "zip": ["zip", "postal code", "postcode", "zip code"],
    "country": ["country", "nation"],
    "card_number": ["card number", "credit card", "debit card", "card #"],
    "card_expiry": ["expiry", "expiration", "exp date", "valid thru"],
    "card_cvv": ["cvv", "cvc", "security code", "card verification"],
    "date": ["date", "when"],
    "date_of_birth": ["birth", "dob", "birthday", "date of birth"],
    "quantity": ["quantity", "qty", "amount", "count", "number of"],
    "price": ["price", "cost", "amount", "total"],
    "search": ["search", "find", "lookup", "query"],
    "comment": ["comment", "note", "remarks", "feedback"],
    "message": ["message", "text", "content", "body"],
    "url": ["url", "website", "link", "web address"],
    "file": ["file", "upload", "attachment", "document"],
    "color": ["color", "colour"],
    "selection": ["select", "choose", "option"],
    "toggle": ["enable", "disable", "turn on", "turn off"],
    "consent": ["agree", "consent", "accept", "terms", "privacy", "subscribe"],
}
NAME_PURPOSE = {
    "email": "email", "emailaddress": "email", "email_address": "email",
    "email-address": "email", "useremail": "email", "user_email": "email",
    "phone": "phone", "phonenumber": "phone", "phone_number": "phone", "phone-number": "phone",
    "tel": "phone", "telephone": "phone", "mobile": "phone",
    "password": "password", "passwd": "password", "pass": "password",
    "confirmpassword": "password_confirm", "confirm_password": "password_confirm",
    "passwordconfirm": "password_confirm",
    "firstname": "first_name", "first_name": "first_name", "first-name": "first_name",
    "givenname": "first_name", "lastname": "last_name", "last_name": "last_name",
    "last-name": "last_name", "familyname": "last_name", "fullname": "full_name",
    "full_name": "full_name",
    "username": "username", "user_name": "username", "userid": "username",
    "user_id": "username",
    "streetaddress": "street", "street_address": "street", "addressline": "street",
    "address_line": "street", "city": "city", "state": "state", "province": "state",
    "zip": "zip", "zipcode": "zip", "zip_code": "zip", "postalcode": "zip",
    "postal_code": "zip", "country": "country",
    "cardnumber": "card_number", "card_number": "card_number", "ccnumber": "card_number",
    "cc_number": "card_number", "cvv": "card_cvv", "cvc": "card_cvv", "expiry": "card_expiry",
    "expiration": "card_expiry",
    "dateofbirth": "date_of_birth", "date_of_birth": "date_of_birth", "dob": "date_of_birth",
    "birthday": "date_of_birth", "birthdate": "date_of_birth",
}
KIND_PURPOSE = {
    "checkbox": ("toggle", 0.5), "radio": ("selection", 0.5), "select": ("selection", 0.5),
    "combobox": ("selection", 0.5), "textarea": ("message", 0.4), "slider": ("quantity", 0.4),
}
METHOD_BOOST = {
    "aria_controls": 0.3, "data_attribute": 0.25, "observed_mutation": 0.1,
    "observed_state_change": 0.15, "structural_inference": 0.05, "naming_convention": 0.05,
}
MASK_DOTS = "••••••••"
MASK_STARS = "********"

# ---------------------------------------------------------------------------------------------
# observations
# ---------------------------------------------------------------------------------------------
SIGNIFICANCE_WEIGHTS = {
    "has_alert_role": 3, "has_aria_live": 3, "is_dialog": 3, "is_fixed_or_sticky": 2,
    "has_high_z_index": 1, "covers_viewport": 2, "is_body_child": 1, "has_interactives": 1,
    "is_visible": 2, "has_text": 1, "after_delay": 2, "short_lived": 2,
}
TOAST_LIBRARY_WEIGHT = 3
ALERT_ROLES = ["alert", "status", "log", "alertdialog"]
LIVE_REGION_ROLES = ["alert", "status", "log", "marquee", "timer"]
EXCLUDED_TEXT_TAGS = ["STYLE", "SCRIPT", "NOSCRIPT", "TEMPLATE", "SVG"]
OBS_TAG_KINDS = {
    "a": ["link"], "button": ["button"],
    "input": ["input", "checkbox", "radio", "switch", "slider"], "textarea": ["textarea"],
    "select": ["select", "combobox"],
    "div": ["generic", "dialog", "section", "button", "link"], "span": ["generic", "text"],
    "section": ["section", "generic"], "dialog": ["dialog"], "nav": ["navigation"],
    "form": ["form"], "h1": ["heading"], "h2": ["heading"], "h3": ["heading"],
    "h4": ["heading"], "h5": ["heading"], "h6": ["heading"], "p": ["paragraph", "text"],
    "img": ["image"], "ul": ["list"], "ol": ["list"], "li": ["listitem"], "video": ["media"],
    "audio": ["media"], "table": ["table"],
}
OBS_ROLE_KIND = {
    "alert": "generic", "alertdialog": "dialog", "dialog": "dialog", "button": "button",
    "link": "link", "textbox": "input", "checkbox": "checkbox", "radio": "radio",
    "combobox": "combobox", "listbox": "combobox", "menu": "navigation", "menuitem": "menuitem",
    "tab": "tab", "tabpanel": "section", "navigation": "navigation", "form": "form",
    "search": "form",
}
LINK_SCORES = {"tag": 0.3, "role": 0.25, "text": 0.3, "dialog": 0.15}
CHILD_TAGS = {
    "button": "button", "link": "link", "heading": "heading", "input": "input",
    "textarea": "input", "select": "select", "combobox": "select", "checkbox": "checkbox",
    "radio": "checkbox", "switch": "checkbox", "slider": "slider", "tab": "tab",
    "menuitem": "tab",
}

# ---------------------------------------------------------------------------------------------
# network
# ---------------------------------------------------------------------------------------------
KEPT_REQUEST_HEADERS = ["content-type", "accept", "content-length", "x-requested-with"]
KEPT_RESPONSE_HEADERS = ["content-type", "content-length", "cache-control", "location"]
MAX_BODY = 2048
BODY_MARK = "…[truncated]"
