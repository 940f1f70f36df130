"""Fixed values as the SQL expects them, written out once more so that a wrong constant in the rules shows."""

PLATFORM_HOSTS = [
    ('greenhouse.io', 'greenhouse'),
    ('lever.co', 'lever'),
    ('apply.workable.com', 'workable'),
    ('teamtailor.com', 'teamtailor'),
    ('icims.com', 'icims'),
    ('taleo.net', 'taleo'),
    ('myworkdayjobs.com', 'workday'),
    ('workforcenow.adp.com', 'adp'),
    ('applicantpro.com', 'applicantpro'),
]
HOSTING_LABELS = [
    ('idealist.org', 'idealist.org (aggregator)'),
    ('greenhouse.io', 'greenhouse.io'),
    ('lever.co', 'lever.co'),
    ('workable.com', 'workable.com'),
    ('teamtailor.com', 'teamtailor.com'),
    ('icims.com', 'icims.com'),
    ('myworkdayjobs.com', 'myworkdayjobs.com'),
    ('applicantpro.com', 'applicantpro.com'),
]
PROBE_PATTERNS = [
    ('greenhouse', 'greenhouse\\.io'),
    ('lever', 'lever\\.co'),
    ('workable', 'workable\\.com'),
    ('jobvite', 'jobvite\\.com'),
    ('icims', 'icims\\.com'),
    ('workday', 'myworkdayjobs\\.com'),
    ('breezy', 'breezy\\.hr'),
    ('bamboohr', 'bamboohr\\.com'),
    ('paylocity', 'paylocity\\.com'),
    ('teamtailor', 'teamtailor\\.com'),
    ('applytojob', 'applytojob\\.com'),
    ('ultipro', 'ultipro\\.com'),
    ('adp', 'adp\\.com.*recruitment'),
    ('taleo', 'taleo\\.net'),
]
TAGS = [
    ('Remote', ['remote', 'work from home', 'wfh', 'telecommute']),
    ('Hybrid', ['hybrid', 'flexible']),
    ('On-site', ['on-site', 'onsite', 'in-office', 'office-based']),
    ('Full-time', ['full-time', 'full time', 'fulltime']),
    ('Part-time', ['part-time', 'part time', 'parttime']),
    ('Contract', ['contract', 'contractor']),
    ('Internship', ['internship', 'intern']),
    ('Volunteer', ['volunteer']),
    ('Senior', ['senior', 'sr.', 'lead', 'principal', 'staff']),
    ('Junior', ['junior', 'jr.', 'entry level', 'entry-level']),
    ('Leadership', ['director', 'vp', 'vice president', 'head of', 'chief']),
]
RELEVANCE_HIGH = [
    'program',
    'policy',
    'grants',
    'advocacy',
    'strategy',
    'research',
    'philanthropy',
    'director',
    'manager',
    'officer',
]
RELEVANCE_MEDIUM = [
    'communications',
    'partnerships',
    'development',
    'coordinator',
    'analyst',
    'associate',
    'operations',
    'engagement',
    'community',
]
ORGANISATION_SUFFIXES = [
    'foundation',
    'fund',
    'institute',
    'inc',
    'llc',
    'trust',
    'philanthropies',
    'ventures',
    'collective',
    'network',
    'group',
    'initiative',
    'project',
]
SALARY_PATTERNS = [
    '()(\\$\\s*(?:\\d{2,3}(?:\\.\\d)?k|\\d{1,3}(?:,\\d{3})*)\\s*(?:-|–|—|to|through)\\s*\\$?\\s*(?:\\d{2,3}(?:\\.\\d)?k|\\d{1,3}(?:,\\d{3})*)(?:\\s*(?:/|per\\s+)?\\s*(?:year|yr|annually|annual|annum|hour|hr|hourly|month|monthly|week|weekly))?)',
    '()(USD\\s*(?:\\d{2,3}(?:\\.\\d)?k|\\d{1,3}(?:,\\d{3})*)\\s*(?:-|–|—|to|through)\\s*(?:\\d{2,3}(?:\\.\\d)?k|\\d{1,3}(?:,\\d{3})*)(?:\\s*(?:/|per\\s+)?\\s*(?:year|yr|annually|annual|annum|hour|hr|hourly|month|monthly|week|weekly))?)',
    '()(\\$\\s*(?:\\d{2,3}(?:\\.\\d)?k|\\d{1,3}(?:,\\d{3})*)\\s*/?\\s*(?:year|yr|annually|annual|per\\s+annum|hour|hr|hourly|month|monthly|week|weekly))',
    '(?:salary|compensation|pay|earning|wage|stipend|range)[:\\s]*()(\\$\\s*(?:\\d{2,3}(?:\\.\\d)?k|\\d{1,3}(?:,\\d{3})*))',
]
SALARY_REJECT = 'budget|revenue|endowment|grant|award|fund|donation|assets?|portfolio'
