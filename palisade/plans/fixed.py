"""The strings of the public contract, in their published order."""

TYPES = ("string", "integer", "float", "decimal", "boolean", "datetime")
NUMERIC = ("integer", "float", "decimal")
COMPARISONS = ("eq", "ne", "gt", "ge", "lt", "le")
AGGREGATES = ("count", "sum", "avg", "min", "max")
ROLES = ("identifier", "spatial", "temporal")
VALUE_STATES = ("raw", "redacted", "hashed", "nullified")
DECISIONS = ("PERMIT", "DENY", "INDETERMINATE", "NOT_APPLICABLE")
STATUSES = ("ACCEPT", "REWRITE", "CLARIFY", "REJECT")
OBLIGATIONS = ("VERSION_PIN", "MASK", "GENERALIZE_LOCATION", "MIN_GROUP_SIZE", "EXPORT_CONTROL", "LINEAGE_CAPTURE")
LINEAGE_LEVELS = ("none", "source", "record")
ACTIONS = ("read", "join", "aggregate", "export")
EVENTS = (
    "PlanApproved",
    "OperatorStarted",
    "OperatorCompleted",
    "PolicyDecisionRecorded",
    "ResultMaterialized",
    "LineageRecorded",
    "CertificateEmitted",
)

REASON_CODES = """
PLAN_PARSE_ERROR
MISSING_REQUIRED_FIELD
UNKNOWN_OPERATOR
INVALID_OPERATOR_ARGUMENT
DUPLICATE_OPERATOR_ID
UNBOUND_REFERENCE
CYCLIC_PLAN
UNREACHABLE_OPERATOR
OUTPUT_OPERATOR_UNKNOWN
UNKNOWN_DATASET
UNKNOWN_FIELD
FIELD_NOT_AVAILABLE
DUPLICATE_OUTPUT_FIELD
JOIN_KEY_TYPE_MISMATCH
SPATIAL_FIELD_REQUIRED
SPATIAL_DESCRIPTOR_NOT_FOUND
SPATIAL_CRS_MISMATCH
TEMPORAL_FIELD_TYPE_INVALID
INVALID_TIME_RANGE
AMBIGUOUS_OUTPUT_FIELD
GENERALIZATION_TARGET_NOT_SPATIAL
OPERATOR_SEMANTICS_UNSUPPORTED
EXPRESSION_TYPE_MISMATCH
AGGREGATE_TYPE_NOT_SUPPORTED
MASK_INPUT_TYPE_UNSUPPORTED
MASKED_FIELD_USED_SEMANTICALLY
LINEAGE_REQUIREMENT_UNSATISFIED
LINEAGE_INSTRUMENTATION_MISSING
LINEAGE_LEVEL_INSUFFICIENT
LINEAGE_EVIDENCE_MISSING
LINEAGE_EVIDENCE_INCONSISTENT
LINEAGE_TARGET_NOT_COVERED
CERTIFICATE_BINDING_MISMATCH
PHYSICAL_PLAN_BINDING_MISMATCH
CERTIFICATE_SNAPSHOT_MISMATCH
CERTIFICATE_DIGEST_MISSING
CERTIFICATE_RESULT_DIGEST_MISMATCH
CERTIFICATE_EVENT_MISSING
CERTIFICATE_EVENT_ORDER_INVALID
CERTIFICATE_OPERATOR_EVENT_MISSING
CERTIFICATE_OPERATOR_DEPENDENCY_VIOLATION
CERTIFICATE_PHYSICAL_PLAN_CYCLIC
CERTIFICATE_PHYSICAL_OPERATOR_UNKNOWN
CERTIFICATE_PHYSICAL_OPERATOR_DUPLICATE
CERTIFICATE_PLANNER_DECISION_MISMATCH
PHYSICAL_PLAN_PLANNER_DECISION_MISMATCH
OBLIGATION_NOT_ENFORCED
OBLIGATION_PARAMETER_INVALID
OBLIGATION_NORMALIZATION_FAILED
MASK_METHOD_CONFLICT
PURPOSE_MISSING
POLICY_DENIED
POLICY_INDETERMINATE
POLICY_NOT_APPLICABLE
POLICY_CONFLICT
VERSION_UNRESOLVED
SPATIAL_PRECISION_EXCEEDED
MASK_REQUIRED
MIN_GROUP_SIZE_REQUIRED
EXPORT_FORBIDDEN
LINEAGE_REQUIRED
OBLIGATION_CONFLICT
REWRITE_CYCLE_DETECTED
REWRITE_DID_NOT_CONVERGE
""".split()

#: Kilometres of a degree in planar distance and in grid cells, and the radius of the sphere in great-circle distance.
KM_PER_DEGREE = 111.045
EARTH_RADIUS_KM = 6371.0088
REDACTED = "[REDACTED]"
WGS84 = "EPSG:4326"
