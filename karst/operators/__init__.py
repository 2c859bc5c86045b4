"""Graph, product, detection, geometry and tree operators over relations."""
