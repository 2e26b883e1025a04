MODULES = ("core_problems", "edge_queries", "lattice_queries", "graph_queries", "pipeline_queries", "check_queries", "viewer_queries", "prompt_queries", "stream_queries")
