from codeq.rules.catalogue import (
    BADGES,
    CATEGORIES,
    LANGUAGES,
    PATTERN_RULES,
    SEVERITIES,
    STATUSES,
    PatternRule,
)
