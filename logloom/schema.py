"""Fixed values of the log format, and enumerations in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: event types of the log format, by the projection that reads them
METHOD_TYPES = ("METHOD_ENTRY", "METHOD_EXIT", "CONSTRUCTOR_ENTRY", "CONSTRUCTOR_EXIT")
QUERY_TYPES = ("SOQL_EXECUTE_BEGIN", "SOQL_EXECUTE_END", "SOQL_EXECUTE_EXPLAIN")
DML_TYPES = ("DML_BEGIN", "DML_END")
LIMIT_TYPES = ("LIMIT_USAGE", "LIMIT_USAGE_FOR_NS", "CUMULATIVE_LIMIT_USAGE", "CUMULATIVE_LIMIT_USAGE_END")
EXCEPTION_TYPES = ("EXCEPTION_THROWN", "FATAL_ERROR")
PACKAGE_TYPES = ("ENTERING_MANAGED_PKG", "PUSH_TRACE_FLAGS", "POP_TRACE_FLAGS")
DEBUG_TYPES = ("USER_DEBUG", "SYSTEM_DEBUG")
HEAP_TYPES = ("HEAP_ALLOCATE", "HEAP_DEALLOCATE")
SYSTEM_METHOD_TYPES = ("SYSTEM_METHOD_ENTRY", "SYSTEM_METHOD_EXIT", "SYSTEM_CONSTRUCTOR_ENTRY", "SYSTEM_CONSTRUCTOR_EXIT")
SYSTEM_MODE_TYPES = ("SYSTEM_MODE_ENTER", "SYSTEM_MODE_EXIT")
FLOW_DETAIL_TYPES = ("FLOW_ASSIGNMENT_DETAIL", "FLOW_ACTIONCALL_DETAIL", "FLOW_LOOP_DETAIL", "FLOW_RULE_DETAIL", "FLOW_SUBFLOW_DETAIL", "FLOW_COLLECTION_PROCESSOR_DETAIL")
FLOW_TYPES = (
    "FLOW_START_INTERVIEW_BEGIN", "FLOW_START_INTERVIEW_END", "FLOW_START_INTERVIEWS_BEGIN", "FLOW_START_INTERVIEWS_END",
    "FLOW_START_INTERVIEW_LIMIT_USAGE", "FLOW_ELEMENT_BEGIN", "FLOW_ELEMENT_END", "FLOW_ELEMENT_DEFERRED", "FLOW_ELEMENT_LIMIT_USAGE",
    "FLOW_BULK_ELEMENT_BEGIN", "FLOW_BULK_ELEMENT_END", "FLOW_BULK_ELEMENT_DETAIL", "FLOW_BULK_ELEMENT_LIMIT_USAGE",
    "FLOW_CREATE_INTERVIEW_BEGIN", "FLOW_CREATE_INTERVIEW_END", "FLOW_INTERVIEW_FINISHED", "FLOW_INTERVIEW_FINISHED_LIMIT_USAGE",
)
WORKFLOW_TYPES = ("WF_ACTIONS_END", "WF_EMAIL_SENT")
CODE_UNIT_TYPES = ("CODE_UNIT_STARTED", "CODE_UNIT_FINISHED")
PLAIN_TYPES = (
    "USER_INFO", "TOTAL_EMAIL_RECIPIENTS_QUEUED", "CUMULATIVE_PROFILING", "STATIC_VARIABLE_LIST", "VARIABLE_SCOPE_BEGIN", "VARIABLE_SCOPE_END",
    "DUPLICATE_DETECTION_RULE_INVOCATION", "DUPLICATE_DETECTION_MATCH_INVOCATION_SUMMARY", "DUPLICATE_DETECTION_MATCH_INVOCATION_DETAILS",
    "DUPLICATE_DETECTION_BEGIN", "DUPLICATE_DETECTION_END", "CALLOUT_REQUEST", "CALLOUT_RESPONSE", "EXECUTION_STARTED", "EXECUTION_FINISHED",
    "TESTING_LIMITS", "CUMULATIVE_PROFILING_BEGIN", "CUMULATIVE_PROFILING_END", "REFERENCED_OBJECT_LIST",
)
ASYNC_TYPES = ("ASYNC_JOB_ENQUEUED", "FUTURE_CALL", "QUEUEABLE_JOB", "BATCH_APEX_START", "BATCH_APEX_END")
HANDLED_TYPES = (
    *METHOD_TYPES, *QUERY_TYPES, *DML_TYPES, *LIMIT_TYPES, *EXCEPTION_TYPES, *PACKAGE_TYPES, *DEBUG_TYPES, "VARIABLE_ASSIGNMENT", "STATEMENT_EXECUTE",
    *HEAP_TYPES, *SYSTEM_METHOD_TYPES, *SYSTEM_MODE_TYPES, "VALIDATION_RULE", "VALIDATION_FORMULA", "FLOW_VALUE_ASSIGNMENT", *FLOW_DETAIL_TYPES,
    *FLOW_TYPES, *WORKFLOW_TYPES, *CODE_UNIT_TYPES, *PLAIN_TYPES,
)
KNOWN_TYPES = (*HANDLED_TYPES, *ASYNC_TYPES)
#: Events that open a call, and those that close one.
ENTRY_TYPES = (
    "METHOD_ENTRY", "CONSTRUCTOR_ENTRY", "CODE_UNIT_STARTED", "SOQL_EXECUTE_BEGIN", "DML_BEGIN", "FLOW_START_INTERVIEW_BEGIN", "FLOW_ELEMENT_BEGIN",
    "EXECUTION_STARTED", "ENTERING_MANAGED_PKG", "SYSTEM_METHOD_ENTRY", "SYSTEM_CONSTRUCTOR_ENTRY", "SYSTEM_MODE_ENTER",
)
EXIT_TYPES = (
    "METHOD_EXIT", "CONSTRUCTOR_EXIT", "CODE_UNIT_FINISHED", "SOQL_EXECUTE_END", "DML_END", "FLOW_START_INTERVIEW_END", "FLOW_ELEMENT_END",
    "EXECUTION_FINISHED", "SYSTEM_METHOD_EXIT", "SYSTEM_CONSTRUCTOR_EXIT", "SYSTEM_MODE_EXIT",
)

#: From lowest to highest.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
DEBUG_LEVELS = ("NONE", "ERROR", "WARN", "INFO", "DEBUG", "FINE", "FINER", "FINEST")
SENSITIVITIES = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")

MAX_LINE = 1 << 20
MAX_LOG_BYTES = 20 << 20
#: Wide event columns beyond the core ones, with their types: what a projection doesn't set is null.
EVENT_FIELDS = {
    "namespace": "string", "method_name": "string", "class_name": "string", "source_location": "string", "source_line": "int", "query": "string",
    "row_count": "long", "aggregations": "long", "query_plan": "struct<cardinality:long,relative_cost:double,sobject_type:string,leading_operation_type:string>",
    "operation": "string", "sobject_type": "string", "limit_name": "string", "used": "long", "max": "long", "exception_type": "string", "message": "string",
    "level": "string", "variable_name": "string", "value_type": "string", "raw_value": "string", "address": "string", "is_external": "boolean",
    "bytes": "long", "method_signature": "string", "mode": "string", "rule_id": "string", "rule_name": "string", "formula": "string",
    "field_values": "string", "interview_id": "string", "detail": "string", "unit_type": "string", "unit_name": "string", "trigger_object": "string",
    "trigger_operation": "string",
}


def ordinal(value: Column, names: tuple[str, ...], first: int = 0) -> Column:
    """Place of value in names, null if it isn't there."""
    place = F.array_position(F.array(*map(F.lit, names)), value)
    return F.when(place > 0, place - 1 + first).cast("int")


def severity_rank(value: Column) -> Column:
    return ordinal(value, SEVERITIES, 1)


def level_rank(value: Column) -> Column:
    return ordinal(value, DEBUG_LEVELS)
