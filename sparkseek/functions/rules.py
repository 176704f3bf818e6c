"""Limits and failure texts of the service contract."""

from __future__ import annotations

# Limits of the service contract.
DEFAULT_RESULTS = 10
MAX_RESULTS = 50
DEFAULT_POOL = 25
MAX_POOL = 200
MAX_QUESTION = 1000
MAX_FILTER_VALUE = 200
MAX_USER = 200
MAX_REASON = 1000
MAX_SIMILARITIES = 50
MAX_NAME = 200
MAX_NAME_FILTER = 200
MAX_GIT_URL = 2000
DEFAULT_WINDOW_DAYS = 30
MAX_WINDOW_DAYS = 366

# Failure codes (HTTP status, then slug) and the texts callers see.
# "%s" takes the row's value: a project id, a project name or a time zone.
FAILURES: dict[str, str] = {
    "400-question-required": "The 'question' field is required and must not be empty.",
    "400-question-too-long": "The 'question' field must be at most 1000 characters long.",
    "400-limit-out-of-range": "The 'limit' field must be between 1 and 50.",
    "400-min-similarity-out-of-range": "The 'minSimilarity' field must be between 0.0 and 1.0.",
    "400-kind-filter-operator-unknown": "The 'kind' filter's 'operator' field must be one of contains, equals, not_equals.",
    "400-kind-filter-value-required": "The 'kind' filter's 'value' field is required and must not be empty.",
    "400-kind-filter-value-too-long": "The 'kind' filter's 'value' field must be at most 200 characters long.",
    "400-namespace-filter-operator-unknown": "The 'namespace' filter's 'operator' field must be one of contains, not_contains, equals, not_equals.",
    "400-namespace-filter-value-required": "The 'namespace' filter's 'value' field is required and must not be empty.",
    "400-namespace-filter-value-too-long": "The 'namespace' filter's 'value' field must be at most 200 characters long.",
    "400-type-name-filter-operator-unknown": "The 'typeName' filter's 'operator' field must be one of contains, not_contains, equals.",
    "400-type-name-filter-value-required": "The 'typeName' filter's 'value' field is required and must not be empty.",
    "400-type-name-filter-value-too-long": "The 'typeName' filter's 'value' field must be at most 200 characters long.",
    "400-useful-required": "The 'useful' field is required.",
    "400-similarities-required": "The 'similarities' field is required. Send an empty array when the original query returned no results.",
    "400-too-many-similarities": "The 'similarities' field must contain at most 50 values.",
    "400-user-required": "The 'user' field is required and must not be empty. For MCP callers, this must be the calling agent/tool's own name.",
    "400-user-too-long": "The 'user' field must be at most 200 characters long.",
    "400-reason-too-long": "The 'reason' field must be at most 1000 characters long.",
    "400-invalid-date-range": "The 'start_date' must not be after 'end_date'.",
    "400-window-too-large": "The requested time window must not exceed 366 days (12 months).",
    "400-invalid-timezone": "'%s' is not a recognized IANA time zone name.",
    "400-name-empty": "The 'name' query parameter must not be empty.",
    "400-name-too-long": "The 'name' query parameter must be at most 200 characters long.",
    "400-name-required": "The 'name' field is required and must not be empty.",
    "400-name-field-too-long": "The 'name' field must be at most 200 characters long.",
    "400-git-url-empty": "The 'git_url' field must not be empty when provided.",
    "400-git-url-too-long": "The 'git_url' field must be at most 2000 characters long.",
    "400-git-raw-url-empty": "The 'git_raw_url' field must not be empty when provided.",
    "400-git-raw-url-too-long": "The 'git_raw_url' field must be at most 2000 characters long.",
    "404-project-not-found": "No project exists with id %s.",
    "409-name-already-exists": "A project named '%s' already exists.",
    "409-has-indexed-code-documents": "Project %s has indexed code documents and cannot be deleted. Remove its indexed code documents first.",
    "409-has-feedback": "Project %s has feedback records and cannot be deleted. Remove its feedback records first.",
}


class RuleViolation(ValueError):
    """A request the contract rejects, with the contract's code and text."""

    def __init__(self, code: str, value: object = None):
        self.code = code
        self.message = FAILURES[code].replace("%s", str(value))
        super().__init__(f"{code}: {self.message}")
