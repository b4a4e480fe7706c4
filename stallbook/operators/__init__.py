"""DataFrame operators: frames and an explicit clock in, frames out, no actions inside."""
