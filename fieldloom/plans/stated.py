"""Fixed values of the rules, stated once more for the SQL: nothing here comes from the operators, so a value that is changed on one side only is found."""

PROMPTS = {
    'name': ['name|applicant|insured|agent|producer'],
    'address': ['address|mailing|street'],
    'city_state_zip': ['city', 'state', 'zip|postal'],
    'address_part': ['\\b(city|state|zip|postal|address|street)\\b'],
    'city': ['^(city)\\s*$'],
    'state': ['^(state|st|state province)\\s*$'],
    'zip': ['^(zip|zip code|postal|postal code)\\s*$'],
    'policy_number': ['\\bpolicy\\b', '\\b(number|no)\\b'],
    'mailing_address': ['\\bmailing\\s+address\\b'],
    'agent_name': ['\\b(agent|producer)\\b', '\\bname\\b'],
    'named_insured': ['\\b(first\\s+named\\s+insured|named\\s+insured|insured\\s+name)\\b'],
    'business_start': ['\\b(date\\s+business\\s+started|business\\s+start\\s+date|date\\s+business)\\b'],
    'identity': ['\\b(named\\s+insured|insured\\s+name|name\\s+of\\s+insured|applicant\\s+name|name\\s+of\\s+applicant|producer|agent|agency|mailing\\s+address|location\\s+address|street\\s+address|business\\s+address|address\\s+line|city|state|postal|zip)\\b'],
    'operations': ['\\b(operations\\s+description|description\\s+of\\s+operations|nature\\s+of\\s+operations|business\\s+description|nature\\s+of\\s+business|premises\\s+operations|operations\\s+in\\s+detail)\\b'],
}
ANCHORS = ['named_insured', 'mailing_address', 'policy_number', 'business_start', 'city', 'state', 'zip', 'agent_name']
FIELD_CUE = 'name|address|city|state|zip|phone|email|date|policy|insured|applicant|dob|birth|effective|expiration|expiry|agent|producer|id|code|operations|premises|subcontractor|description|eff\\b|exp\\b'
FORM_TITLE = 'acord|application|supplement|declaration|certificate|insurance|commercial|workers|compensation|liability'
FORM_FIELD = 'name|address|city|state|zip|postal|phone|email|dob|birth|applicant|insured'
TITLE_WORD = 'acord|application|supplement|declaration|certificate|coverage|liability|insurance|policyholder|commercial'
TITLE_FIELD = 'name|address|city|state|zip|phone|email|date|policy|insured|applicant'
INSTRUCTION_START = '^(if yes|if no|please explain|describe|list |include )'
INSTRUCTION = 'submitted with|supplemental application|application|operations in detail|have you had|claims during|type of work'
ORGANISATION = 'insurance company|agency|services|inc|llc|corporation|fax|phone|www|com'
TELEPHONE = '\\d{3}[\\s\\-\\)]*\\d{3}[\\s\\-]\\d{4}'
HEADER = 'acord|commercial insurance application|supplemental application|applicant information section|edition|copyright|all rights reserved|form no|\\bpage\\s+\\d+\\s+of\\s+\\d+\\b'
TABULAR = '\\byes\\b.*\\bno\\b|\\bno\\b.*\\byes\\b|type of work performed|receipts|location|start date|end date|number of|full time employees|part time employees|day laborers|kind of license|license no|year license issued|date of corporate filing'
STRUCTURE = [
    ('page_number_or_pagination', 0.45, ['footer'], 0, '^(page\\s+)?\\d+\\s*(of\\s*\\d+)?$', None),
    ('form_or_section_header', 0.22, ['header', 'section'], 6, 'application|form|schedule|supplement|declaration|endorsement|policy|coverage', None),
    ('party_header_or_stub', 0.28, ['header'], 0, 'insured|producer|agent|applicant|carrier|company|broker|underwriter', '[:\\-]$'),
    ('branding_or_legal_footer', 0.4, ['logo', 'footer'], 0, 'logo|copyright|all rights reserved|confidential|proprietary', None),
    ('instructional_copy', 0.24, ['instruction'], 0, 'instructions?|please note|complete this section|if yes|if no|explain|describe|list', None),
    ('section_label', 0.2, ['section'], 8, 'section|part|schedule|item|table of contents|summary', None),
    ('contact_or_header_metadata', 0.16, ['metadata'], 10, 'phone|fax|email|http|address|street|city|state|zip', None),
    ('all_caps_banner', 0.18, ['header'], 0, '', '^[A-Z0-9\\s&.,/-]{8,}$'),
]
FAMILY_MARK = ('family_specific_section_marker', 0.18, 'section', 'operations|work performed|business description|premises operations')
STRUCTURE_MATCH = 0.3
HEADER_MATCH = 0.62
TOP_BAND = 120.0
QUESTION = '(?i)\\?$|^(do you|have you|are you|were there|if yes|describe|explain)\\b'
INSURER = '(?i)\\b(insurer|insurance\\s+(company|group|corporation|services))\\b'
FILLABLE = '(?i)[:?]\\s*$|\\b(name|agency|producer|carrier|underwriter|applicant|insured|address|city|state|zip|postal|e-?mail|phone|fax|website|contact|representative|code|number|date|year|years|fein|soc sec|payroll|percentage|rate|amount|premium|deductible|limit|employees|sales|receipts|revenue)\\b'
NOTE = '(?i)^(note|please|instructions?|important)\\b'
RISK_CATEGORIES = [
    ('loss-history', 'loss|claim|incident|prior'),
    ('operations', 'operation|work|class|naics|trade'),
    ('hazard', 'hazard|flammable|height|roof|electrical|chemical'),
    ('exposure', 'exposure|sales|payroll|receipts|units|revenue'),
    ('applicant', 'applicant|insured|entity|experience|years'),
]
SHAPES = {
    'date': '(\\d{4}-\\d{2}-\\d{2})|(\\d{1,2}/\\d{1,2}/\\d{2,4})',
    'boolean': '(?i)^(true|false|yes|no|0|1)$',
    'number': '^-?\\d+(\\.\\d+)?$',
}
ALIASES = [
    ('\\b(agent|agency|broker)\\b', 'producer'),
    ('\\b(applicant|policyholder)\\b', 'insured'),
    ('\\b(zip code|zip|postal code)\\b', 'postal'),
    ('\\b(e mail)\\b', 'email'),
    ('\\b(telephone|tel)\\b', 'phone'),
]
