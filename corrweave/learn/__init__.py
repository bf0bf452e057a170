"""Learning on correlation graphs: small numpy kernels over one graph, and the Spark jobs that spread them over graphs."""
