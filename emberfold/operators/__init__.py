"""Set-based operators over stacks, frames and trees."""
