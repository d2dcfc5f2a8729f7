"""Explicit schemas of the stored tables."""

REQUEST_LOG = (
    "id string, request_id bigint, provider string, model string, input_tokens bigint, output_tokens bigint, "
    "duration_ms bigint, from_cache bigint, cache_source string, compressed bigint, created_at bigint, "
    "original_model string, routed_model string, routing_method string, routing_tier string, cost_usd double, "
    "saved_usd double, user_label string")
POLICY_LOG = "id bigint, created_at bigint, user_label string, policy_name string, action string, detail string"
CACHE_ENTRIES = ("id bigint, request_hash string, response_body string, provider string, model string, "
                 "input_tokens bigint, output_tokens bigint, created_at bigint, expires_at bigint")
MEMORY_STORE = "session_id string, turn bigint, role string, content string, created_at bigint"
POLICY_CONFIG = (
    "name string, dlp struct<enabled: boolean, detect: array<string>, action: string, "
    "customPatterns: array<struct<name: string, regex: string>>>, "
    "promptGuard struct<enabled: boolean, blockThreshold: double>, "
    "systemPromptLock struct<prepend: string, append: string>, "
    "outputFilter struct<enabled: boolean, redactPII: boolean>, allowedProviders array<string>, "
    "logging struct<storeContent: boolean, retentionDays: bigint>")
