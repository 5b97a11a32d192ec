"""Error classes of the graph API."""


class GFAParseError(Exception):
    """A malformed line in strict mode."""


class GraphError(Exception):
    """Base of the errors raised by graph edits and look-ups."""


class NodeExists(GraphError):
    pass


class NodeNotFound(GraphError):
    pass


class EdgeExists(GraphError):
    pass


class EdgeNotFound(GraphError):
    pass


class InvalidEdgeEndpoint(GraphError):
    pass
