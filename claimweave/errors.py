"""What callers may catch: one class for each kind of refusal."""


class ClaimError(Exception):
    """The root of all errors of this library."""


class NotFound(ClaimError): ...
class BranchNotFound(NotFound): ...
class IntegrityError(ClaimError): ...
class Unsupported(ClaimError): ...
class ContentCapped(ClaimError): ...
class DanglingReference(NotFound, IntegrityError): ...
class QueryError(ClaimError, ValueError): ...
class MalformedQuery(QueryError): ...
class NoScope(QueryError): ...
class NoHead(QueryError): ...
class ScanShape(QueryError): ...
class WhereForm(QueryError): ...
class ComparisonForm(QueryError): ...
class TimeOperand(QueryError): ...
class Hops(QueryError): ...
class Enum(QueryError): ...
class Bounds(QueryError): ...
class HopBounds(Hops, Bounds): ...
class EnvelopeAxis(QueryError): ...
class OrderField(QueryError): ...
class LayerName(QueryError): ...
class Inadmissible(ClaimError): ...
class MalformedRecord(ClaimError, ValueError): ...
class TimedOut(ClaimError): ...
class Conflict(ClaimError): ...
